"""Each operator on small tables: brute force, nulls, empty and long texts, repeated rows, other columns of clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from jobtide import storage
from jobtide.llm import bpe, decontaminate, gam, htmltext, linededup, maxent, pii, simhash, tokenfile, topk
from jobtide.llm.queries import tokenizer

random.seed(11)
WORDS = [a + b for a in ("ba", "Ko", "ré", "tu") for b in ("n", "lo", "ssi,", "x.")]


def prose(n):
    return " ".join(random.choice(WORDS) for _ in range(n))


LONG = prose(30_000)
TEXTS = [(None, "no id here"), (1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, prose(40)), (6, "<|endoftext|> a　b"), (6, "<|endoftext|> a　b")]
TEXTS += [(k, "\n".join(prose(random.choice([3, 6, 9])) for _ in range(4))) for k in range(7, 40)]
TEXTS += [(k + 100, t) for k, t in TEXTS[5:15] if k]
CLASH = ["fp", "score", "tie", "key", "n_words", "spans", "items", "slot", "row", "news", "found", "gone", "Text_"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(TEXTS, "doc_id long, text string")
    return rows.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASH)]).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer())


def test_bpe_gives_what_the_library_gives(docs, empty):
    lib = library()
    got = sorted((tuple(r) for r in bpe.digests(docs, tokenizer()).collect()), key=str)
    want = []
    for d, t in TEXTS:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        text = lib.decode(ids, skip_special_tokens=False)
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.digests(empty, tokenizer()).count() == 0


def test_bpe_on_odd_pieces():
    with open(tokenizer(), "rb") as f:
        automaton = bpe.Automaton(f.read())
    lib = library()
    parts = ["a", "b", " ", "  ", "\n", "'s", "'ll", "é", "ß", "²", "##", "<|endoftext|>", "\xa0", "日本", "🙂", "\x1c", "aaaaaaa", "ER", "123", "​", "…"]
    for _ in range(1500):
        s = "".join(random.choice(parts) for _ in range(random.randint(0, 12)))
        assert np.frombuffer(automaton.encode(s), "<u4").tolist() == lib.encode(s, add_special_tokens=False).ids
        assert automaton.decode(automaton.encode(s)) == s


def test_token_files_come_back(spark, docs, empty, tmp_path):
    lib = library()
    tokenfile.write(docs, str(tmp_path / "a"), tokenizer(), end=0)
    got = [tuple(r) for r in tokenfile.read(spark, str(tmp_path / "a")).orderBy("start").collect()]
    assert [r[0] for r in got] == sorted((d for d, _ in TEXTS), key=lambda d: (d is not None, d or 0))
    of = {d: np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes() for d, t in TEXTS}
    at = 0
    for d, start, n, ids in got:
        assert (start, n, bytes(ids)) == (at, len(of[d]) // 4, of[d])
        at += n
    tokenfile.write(empty, str(tmp_path / "b"), tokenizer())
    assert tokenfile.read(spark, str(tmp_path / "b")).count() == 0


def test_byte_streams():
    for n in (0, 1, 3, 4, 1000):
        values = np.array([random.choice([0, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1]) for _ in range(n)], np.uint32)
        assert (tokenfile.unpack(*tokenfile.pack(values), n) == values).all()


def plain_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components(docs, empty):
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    fps = [plain_fingerprint(t) for _, t in TEXTS]
    root = list(range(len(fps)))
    for _ in fps:
        root = [min(root[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 2) for i in range(len(fps))]
    least = {r: min((d for (d, _), x in zip(TEXTS, root, strict=True) if x == r and d is not None), default=None) for r in root}
    assert got == {(d, f"{f:016x}", least[r]) for (d, _), f, r in zip(TEXTS, fps, root, strict=True)}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == sorted({x for x in least.values() if x is not None})
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_keep_one_goes_by_row(spark):
    """Ids that are used again, with other texts, and rows without id."""
    a, b, c = "alpha beta gamma delta", "one two three four five", "red green blue black white grey"
    rows = [(1, a), (5, b), (5, a), (None, a), (None, c), (None, c), (7, "some text of no other"), (7, b)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, kept.collect())) == Counter([(1, a), (5, b), (None, c), (7, "some text of no other")])


def test_bit_sliced_links_match_popcounts(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 40)
    base = [random.getrandbits(64) for _ in range(20)]
    values = sorted({b ^ sum(1 << x for x in random.sample(range(64), k)) for b in base for k in (0, 1, 1, 2, 2, 3, 4)} | {(1 << 40) + (k << 1) for k in range(300)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"))
    got = {r.node: r.root for r in simhash.components(links).collect()}
    group = {v: v for v in signed}
    for _ in range(12):
        for i, a in enumerate(values):
            near = [group[signed[j]] for j, b in enumerate(values) if (a ^ b).bit_count() <= 2]
            group[signed[i]] = min(near)
    assert {v: got.get(v, v) for v in signed} == group


def brute_hits(text, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    w, hit, names = cut(text), set(), set()
    for name, t in items:
        x = cut(t)
        for a in range(max(1, len(x) - 12) if x else 0):
            window = x[a : a + 13]
            for i in range(len(w) - len(window) + 1):
                if w[i : i + len(window)] == window:
                    hit |= set(range(i, i + len(window)))
                    names.add(str(name))
    return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


@pytest.mark.parametrize("limit", [1 << 20, 200])
def test_decontamination(spark, docs, empty, limit):
    short = [t for d, t in TEXTS if t and len(t) < 2000]
    items = [(1, " ".join(short[4].split()[2:20])), (2, None), (3, ""), (10, "ban ban"), (10, prose(15)), (11, " ".join(LONG.split()[15_000:15_030])), (None, "lost")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: tuple(r)[1:6] for r in decontaminate.contamination(docs, bench, limit).collect()}
    known = [(n, t) for n, t in items if n is not None and t]
    for d, t in TEXTS:
        want = brute_hits(t, known)
        assert got[d] == (*want, want[1] > 0 and 20 * want[1] >= want[0]), d
    clean = decontaminate.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {d for d, v in got.items() if not v[4]}
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated OR n_hit > 0").count() == 0


def test_fm_index_over_small_shards():
    for _ in range(40):
        letters = "abcde"[: random.choice([1, 2, 5])]
        items = [(str(i), " ".join(random.choice(letters) for _ in range(random.choice([1, 2, 13, 20])))) for i in range(5)]
        texts = [" ".join(random.choice(letters + "Z") for _ in range(random.randint(0, 60))) for _ in range(12)]
        n, spans, found = decontaminate.search(texts, decontaminate.Phrases(items), shard=random.choice([30, 1 << 20]))
        for t, a, b, c in zip(texts, n, spans, found, strict=True):
            want = brute_hits(t, items)
            assert (a, int((b[:, 1] - b[:, 0]).sum()), len(c)) == want[:3]


def test_max_entropy_base_and_gain(docs, empty):
    got = maxent.score(docs).collect()
    cut = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), ""]
    count = Counter()
    for d, t in TEXTS:
        if d is None or zlib.crc32(str(d).encode()) % 7 != 2:
            count.update(cut(t))
    n, v = sum(count.values()), len(count)
    texts = dict(TEXTS)
    assert len(got) == len(TEXTS)
    for r in got:
        w = cut(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(count[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w))
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2) and r.score < 0
    assert maxent.score(empty).count() == 0


def test_pairs_have_the_whole_table():
    words = np.random.default_rng(3).integers(1, maxent.BUCKETS, 400_000)
    pairs = maxent.features(words, np.array([len(words)]))[3] - maxent.SPANS[3]
    assert len(np.unique(pairs)) > 16_000


def test_class_shares_add_up(spark):
    """All words and one unseen word of each form: probabilities of a class come to one."""
    words = spark.createDataFrame([(w, c) for w, c in Counter(prose(500).lower().split()).items()], "token string, c long")
    known = maxent.Counts(words)
    k = maxent._class(F.col("token"), F.col("c"), known.top, known.n)
    share = np.zeros(maxent.CLASSES)
    for r in words.select(k.alias("k"), "c").collect():
        share[r.k] += (r.c + 1) / known.shares[r.k]
    share[maxent.OWN :: maxent.STRATA] += 1 / known.shares[maxent.OWN :: maxent.STRATA]
    assert np.allclose(share[known.shares > 0], 1)


def test_additive_model(spark, docs, empty):
    good = [(k, prose(random.randint(5, 200))) for k in range(300)]
    bad = [(k, " ".join(w.upper() + "!!" for w in prose(random.randint(5, 200)).split())) for k in range(300, 400)]
    texts = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 300)) for k in range(400)] + [(1, None), (9999, 1)], "doc_id long, quality int")
    model = gam.fit(texts, labels)
    rows = gam.score(texts, model).collect()
    assert sum((r.predicted == 1) == (r.doc_id < 300) for r in rows if r.held_out) >= 0.97 * sum(r.held_out for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    kept = gam.keep_good(docs, model)
    assert kept.columns == docs.columns and gam.score(docs, model).count() == len(TEXTS) and gam.keep_good(empty, model).count() == 0
    assert {r.score for r in gam.score(texts, gam.fit(texts, labels.limit(0))).collect()} == {0.5}


def test_line_dedup(spark, docs, empty):
    found = {(r.doc_id, r.tie, r.line) for r in linededup.repeated(docs).collect()}
    tie = lambda t: 42 if t is None else np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).astype(np.int64).item()
    lines = [((d is not None, d or 0, tie(t), j), (d, tie(t), j), x.encode().split()) for d, t in set(TEXTS) for j, x in enumerate((t or "").split("\n")) if len(x.split()) >= 5]
    lines.sort(key=lambda x: x[0])
    want = {x[1] for i, x in enumerate(lines) if any(linededup.within_one(x[2], y[2]) for y in lines[:i])}
    assert found == want and want
    out = linededup.deduplicate(docs)
    assert out.columns == docs.columns and out.count() == len(TEXTS) and linededup.deduplicate(empty).count() == 0
    gone = {}
    for d, t, j in want:
        gone.setdefault((d, t), set()).add(j)
    cut = lambda d, t: None if t is None else "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone.get((d, tie(t)), ()))
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter((d, cut(d, t)) for d, t in TEXTS)


def test_one_word_edits_in_a_large_group(spark):
    rows = [(k, f"one two three w{k} five six") for k in range(400)] + [(1000, "one two three five six"), (1001, "one two X three five six seven")]
    out = {r.doc_id: r.text for r in linededup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [k for k, v in sorted(out.items()) if v] == [0, 1001]


def test_short_lines_repeat(spark):
    """Lines under five words go where they are equal, and a line of four where it is one of five but for a word."""
    rows = [(1, "Read more\n\nAll rights reserved.\none two three four"), (2, "Read  more\n\nRead less\nall rights reserved."), (3, "All rights reserved.\none two X three four\none two three five")]
    out = linededup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), least=linededup.MIN_WORDS)
    assert {r.doc_id: r.text for r in out.collect()} == {1: rows[0][1], 2: "\nRead less\nall rights reserved.", 3: "one two three five"}


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(words, edits):
    words = list(words)
    for _ in range(edits):
        at, how = random.randrange(len(words)), random.choice("rid")
        words[at : at + (how != "i")] = [] if how == "d" else [random.choice(WORDS)]
    return words


def test_several_words_edited(spark):
    """The bound grows with the line: against plain word distances."""
    base = [prose(random.choice([4, 5, 8, 9, 10, 11, 14, 20, 36, 50])).split() for _ in range(40)]
    every = base + [edited(w, random.randint(0, len(w) // 4 + 1)) for w in base for _ in range(4)]
    random.shuffle(every)
    far = {(i, j): plain_distance(every[i], every[j]) for i in range(len(every)) for j in range(i)}
    near = lambda i, j: far[i, j] <= max(len(every[i]), len(every[j])) // 5
    assert all(linededup.within_one([x.encode() for x in every[i]], [x.encode() for x in every[j]]) == near(i, j) for i, j in far)
    want = {i for i in range(len(every)) if any(near(i, j) for j in range(i))}
    assert sum(min(far[i, j] for j in range(i)) > 1 for i in want) > 20
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(every)], "doc_id long, text string")
    assert {r.doc_id for r in linededup.repeated(docs, linededup.MIN_WORDS).select("doc_id").distinct().collect()} == want


def test_line_dedup_leaves_one_table(spark, docs, monkeypatch, tmp_path):
    """Tables on the way and shuffle files go as soon as they are read: they add up to several times the texts."""
    monkeypatch.setattr(storage, "shared_dir", lambda spark: str(tmp_path))
    gone = linededup.repeated(docs, linededup.MIN_WORDS)
    assert len(list(tmp_path.iterdir())) == 1 and gone.count()
    # outside, shuffles are kept for as long as they are referred to
    assert spark.conf.get(storage.CLEANUP, "false") == "false"


def test_earliest_lines_then_every_line():
    """A line is given the earliest line of each key that may be close; on the second way every one, and never itself."""
    known = np.zeros(12, linededup.KNOWN)
    known["ord"], known["n"], known["open"] = [5, 3, 1, 4, 2, 0, 0, 9, 8, 7, 6, 10], 10, True
    known["n"][2] = 5
    known["marks"][3, 0] = 0b11111
    key = np.array([1] * 7 + [2] * 5, np.uint32)
    pairs = lambda every: {(int(x), int(y)) for a, b in linededup._earlier(key, known, every) for x, y in zip(a, b, strict=True)}
    # line 1 is too short for the others, line 4 has five words that no other has, of which two edits take four
    assert pairs(False) == {(2, 0), (3, 0), (5, 0), (7, 6), (8, 6), (9, 6), (10, 6)}
    every = {(a, b) for group in ([0, 2, 3, 5], [6, 7, 8, 9, 10]) for a in group for b in group if b < a}
    assert pairs(True) == every
    known["open"] = known["ord"] == 5
    assert pairs(True) == {(5, 0), (5, 2), (5, 3)}


def test_lines_are_dealt_out_in_bulk(spark):
    """As many rows as parts, not parts times batches, and no entry lost; a row holds what its part has."""
    pieces = [(np.arange(k, dtype=np.int64), np.full(k, k)) for k in (3, 0, 5, 4, 0)]
    bulk = list(linededup._in_bulk(iter(pieces), 6))
    assert [len(x) for x, _ in bulk] == [8, 4] and np.concatenate([y for _, y in bulk]).tolist() == [3] * 3 + [5] * 5 + [4] * 4
    assert not list(linededup._in_bulk(iter(pieces[1:2]), 6))
    key = np.array([5, 2**63, 7, 2**63 + 9], np.uint64)
    (batch,) = linededup._dealt_keys(iter([(key, np.arange(4))]), 1)
    held = {part: [x.tolist() for x in columns] for part, columns in linededup._gathered(iter([batch, batch]), "<u4", "<i8")}
    assert held == {0: [[5, 7, 5, 7], [0, 2, 0, 2]], 1: [[0, 9, 0, 9], [1, 3, 1, 3]]}


def test_pair_counts_are_whole(spark):
    """Counts of pairs come to the driver as bytes and are those of every sampled text."""
    rows = [(k, " ".join(f"w{k % 5}x{j}" for j in range(9))) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    want, total = docs.where(F.pmod(F.xxhash64("text"), F.lit(linededup.PAIR_SAMPLE)) == 0).collect(), np.zeros(linededup.PAIR_BUCKETS, np.int64)
    for r in want:
        cut = linededup.Cut([r.text.encode()])
        for _, _, bucket in linededup._pairs(cut, np.array([0]), None):
            total += np.bincount(bucket, minlength=len(total))
    assert (linededup._rare(docs) == np.log2(np.maximum(total, 1)).astype(np.uint8)).all()


def test_top_k(spark):
    rows = [(k, [random.choice([0.0, 0.5, -0.25, 1.1]) for _ in range(6)]) for k in range(300)]
    rows += [(400, None), (450, []), (500, [1.0, None]), (550, [float("nan"), 1.0]), (600, [2.0]), (None, [1.0]), (50, [9.0] * 6)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("q", F.lit(1))
    got = sorted(tuple(r) for r in topk.search(table, F.col("vec_id") % 50 == 0).collect() if r.query_id != 50)
    fine = [(k, [math.floor(256 * x) for x in v]) for k, v in rows if k is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, a in fine:
        if q % 50 == 0 and q != 50:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), k) for k, b in fine if k != q)[:5]
            want += [(q, n + 1, k, -s) for n, (s, k) in enumerate(scored)]
    assert got == sorted(want)
    assert topk.search(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_of_few_rows(spark):
    table = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.search(table, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 131072)]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("a &lt; b &amp; c < d", "a < b & c < d"),
        ("<title>t</title><p>One<p>Two <b>bo</b>ld<br>next", "One\n\nTwo bold\nnext"),
        ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul>z", "- a\n- b\n  3. x\n  4. y\n- c\n\nz"),
        ("<table><tr><th>Name<th>n<tr><td>apple<td>3<tr><td colspan=2>wide</table>", "Name   n\napple  3\nwide"),
        ("<div hidden>no</div><p style='display: none'>no</p><script>if (a<b) x()</script>yes", "yes"),
        ("<pre>\n a\n  b</pre>", " a\n  b"),
        ("<details><summary>s</summary>shut</details><details open><summary>t</summary>open</details>", "s\nt\nopen"),
        ("x</p></td>y<!-- c -->z", "xyz"),
    ],
)
def test_page_text(page, text):
    assert htmltext.render(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("a<svg><title>t</title><desc>d</desc><defs><text>no</text></defs><text>Q1</text><text x=1>Q2</text></svg>b", "a\nQ1\nQ2\nb"),
        ("<svg><defs/><style/><circle r=1 /><g display=none><text>no</text></g><text>label</text></svg>", "label"),
        ("so <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation>x=2</annotation></semantics></math> holds", "so x=2 holds"),
        ("<div style='visibility:hidden'>no<br><q>no</q><p style='visibility: visible'>yes</p>no</div>end", "yes\n\nend"),
        ("<ul><li style='visibility:hidden'>no<li>a</ul><p style='visibility:hidden'>no <b style='visibility:inherit'>no</b></p>z", "- a\n\nz"),
        ("<table><tr style='visibility:collapse'><td>no<tr><td>b</table>", "b"),
    ],
)
def test_drawings_formulas_and_visibility(page, text):
    assert htmltext.render(page) == text


def test_pages(spark):
    rows = [(1, None), (2, "<p>x"), (2, "<p>x"), (None, "<div>" * 5000 + "deep"), (3, "w " * 50_000)]
    table = spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit("other"))
    assert Counter(map(tuple, htmltext.extract(table).collect())) == Counter([(1, ""), (2, "x"), (2, "x"), (None, "deep"), (3, ("w " * 50_000).strip())])
    assert htmltext.extract(table.limit(0)).count() == 0


def test_surrogates(spark, docs, empty):
    rows = [
        (1, "Mail bob.x@Mail.example.com or BOB.X@MAIL.EXAMPLE.COM, call +1 (988) 555-2485 or +1 988-555-2485, card 4539 1488 0343 6467, ip 39.197.112.39."),
        (2, "Mr. John Smith met Mrs. Anna Smith and Dr. SMITH. IBAN DE89 3704 0044 0532 0130 00, password=e3b3ed3cc8548923d6"),
        (2, "Mr. John Smith met Mrs. Anna Smith and Dr. SMITH. IBAN DE89 3704 0044 0532 0130 00, password=e3b3ed3cc8548923d6"),
        (3, "39.197.112.39 and secret: \"------\" twice secret: \"------\""),
        (4, "Version 2.0. is clean"),
    ]
    got = [(r.doc_id, r.text, r.n_entities) for r in pii.replace(spark.createDataFrame(rows, "doc_id long, text string"), "k", counts=True).orderBy("doc_id").collect()]
    first, second, third = got[0][1], got[1][1], got[3][1]
    for old in ("bob.x", "988", "4539", "39.197", "John", "Smith", "SMITH", "Anna", "3704", "e3b3ed"):
        assert old not in first + second + third
    m = re.match(r"Mail (\S+@\S+\.com) or (\S+), call \+1 \((\d{3})\) (\d{3})-(\d{4}) or \+1 (\d{3})-(\d{3})-(\d{4}), card (\d{4} \d{4} \d{4} \d{4}), ip ([\d.]+)\.$", first)
    assert m and m[1].upper() == m[2] and m.group(3, 4, 5) == m.group(6, 7, 8) and third == m[10] + ' and secret: "------" twice secret: "------"'
    digits = [int(c) for c in m[9].replace(" ", "")]
    assert sum(d if i % 2 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0
    n = re.match(r"Mr\. (\w+) (\w+) met Mrs\. (\w+) (\w+) and Dr\. (\w+)\. IBAN (DE\d\d(?: \w{4}){4} \w\w), password=([0-9a-f]{18})$", second)
    assert n and n[2] == n[4] and n[5] == n[2].upper() and n[1] in pii.NAMES["given", "m", "latin"] and n[3] in pii.NAMES["given", "f", "latin"]
    iban = n[6].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert got[1] == got[2] and got[4] == (4, "Version 2.0. is clean", 0)
    out = pii.replace(docs, "k")
    assert out.columns == docs.columns and Counter((r.doc_id, r.text) for r in out.collect()) == Counter(TEXTS)
    assert pii.replace(empty, "k").count() == 0


def test_names_again_without_title(spark):
    rows = [(1, "Keller wrote. Mrs. Anna Keller came; then Anna Keller, KELLER and Keller's dog met Kellerman. keller"), (2, "Keller stays where nobody is titled, mail a.b@c.de")]
    got = {r.doc_id: (r.text, r.n_entities) for r in pii.replace(spark.createDataFrame(rows, "doc_id long, text string"), "k", counts=True).collect()}
    m = re.match(r"(\w+) wrote\. Mrs\. (\w+) (\w+) came; then (\w+) (\w+), (\w+) and (\w+)'s dog met Kellerman\. keller$", got[1][0])
    assert m and m[2] == m[4] != "Anna" and m[1] == m[3] == m[5] == m[7] != "Keller" and m[6] == m[3].upper() and got[1][1] == 6
    assert got[2][0].startswith("Keller stays") and got[2][1] == 1


def test_keys_of_letters_only(spark):
    rows = [(1, "use AKIA" + "ABCDEFGH" * 2 + " now"), (2, "use ghp_" + "abcDEfghij" * 2 + " now")]
    out = [r.text for r in pii.replace(spark.createDataFrame(rows, "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    assert "ABCDEFGH" not in out[0] and "abcDE" not in out[1] and out[0].startswith("use AKIA")


def test_grown_surrogates_are_written_whole(spark):
    row = spark.range(1).select(*[pii._written(F.lit(k), F.lit(v), F.lit(s)) for k, v, s in (("phone", "55 512-345", "98765432ab"), ("phone", "55 512-345", "98765432"), ("iban", "DE89 3704", "DE123456x"))]).first()
    assert tuple(row) == ("98 765-432ab", "98 765-432", "DE12 3456x")


def test_surrogates_stay_distinct(spark):
    """More family names than the pool has, and all of one small space of addresses."""
    rows = [(k, f"Mr. {'ABCDEFGHIJ'[k // 10]}lo{'abcdefghij'[k % 10]}er wrote from {1 + k % 9}.{1 + k // 9}.3.4") for k in range(80)]
    table = pii.replace(spark.createDataFrame(rows, "doc_id long, text string"), "k")
    out = [re.match(r"Mr\. ([\w-]+) wrote from ([\d.]+)$", r.text).groups() for r in table.collect()]
    assert len({a for a, _ in out}) == 80 and len({b for _, b in out}) == 80
