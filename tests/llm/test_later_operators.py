"""Piecewise hashes, periodic runs and hard negatives against plain versions, on odd rows and empty tables."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobtide.llm import fuzzyhash, htmltext, linededup, maxent, negatives, queries, runs, topk

WORDS = [a + b for a in ("ba", "Ko", "ré", "tu", "😀") for b in ("n", "lo", "ssi,", "x.")]
CLASH = ["fingerprint", "Text_", "part", "first", "runs", "h", "n", "g", "label_", "own", "v", "score", "rank"]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)

    def prose(n):
        return " ".join(r.choice(WORDS) for _ in range(n))

    out = [(None, "no id"), (None, None), (1, None), (2, ""), (3, " \n\t "), (4, prose(20_000)), (5, "a"), (6, "same text"), (6, "same text"), (7, "same text"), (8, "ab " * 4000)]
    out += [(k, "\n".join(prose(r.choice([3, 9, 40])) for _ in range(4))) for k in range(10, 90)]
    out += [(-9, "x" * 3000), (90, " ".join(["one two three"] * 9) + " tail"), (91, "one " * 5), (92, "one " * 6)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    return rows.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASH)]).repartition(3)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def plain_fingerprint(raw):
    """Byte by byte, with whole numbers."""
    mask = (1 << 64) - 1

    def mixed(x):
        for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xBF58476D1CE4E5B9)):
            x = (x ^ x >> shift) * factor & mask
        return x ^ x >> 32

    value = [mixed((b + 1) * fuzzyhash._FACTOR & mask) for b in raw]
    rolling = [mixed(sum(value[i - k] * pow(fuzzyhash._FACTOR, k, 1 << 64) for k in range(min(7, i + 1))) & mask) for i in range(len(raw))]
    digits = fuzzyhash._DIGITS

    def letters(scale):
        out, total = [], 0
        for i, h in enumerate(rolling):
            total += h
            if h % (1 << scale) == 0 or i == len(raw) - 1:
                x = mixed(total & mask) >> 52
                out.append(digits[x // 64] + digits[x % 64])
                total = 0
        return out

    scale = 0
    while len(letters(scale)) > 64:
        scale += 1
    return ":".join([str(scale), *("".join(letters(scale + k)) for k in range(3))])


def test_fingerprints_are_those_of_a_plain_version(texts):
    for _, text in texts:
        raw = (text or "").encode()[:9000]
        assert fuzzyhash.fingerprint(raw) == plain_fingerprint(raw)
    assert fuzzyhash.fingerprint(b"") == "0:::"


def test_letters_are_compared_by_edit_distance():
    r = random.Random(1)
    for _ in range(400):
        a, b = ([r.choice("abcdef") for _ in range(r.randrange(70))] for _ in range(2))
        assert fuzzyhash.distance(a, b) == edits(a, b)


def test_likeness_follows_edits_and_is_low_for_other_texts(texts):
    long = [t for _, t in texts if t and 400 < len(t) < 5000 and len(set(t)) > 5]
    marks = [fuzzyhash.fingerprint(t.encode()) for t in long]
    for k, text in enumerate(long):
        one = fuzzyhash.likeness(marks[k], fuzzyhash.fingerprint((text[:200] + "CHANGED" + text[207:]).encode()))
        half = fuzzyhash.likeness(marks[k], fuzzyhash.fingerprint(fuzzyhash.edited(text, long[k - 1]).encode()))
        assert one > 0.75 and 0.2 < half < 0.85
        assert fuzzyhash.likeness(marks[k], marks[k - 1]) < 0.2 and fuzzyhash.likeness(marks[k], marks[k]) == 1


def test_each_document_meets_the_next_one(docs, texts):
    got = sorted((tuple(r) for r in fuzzyhash.with_edited(docs).collect()), key=str)
    order = sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0))
    # rows without id, or of one id, are in an order of their own: only those not followed by one are compared in full
    want = {}
    for k, (d, t) in enumerate(order):
        t, u = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        changed = t[: len(t) - half] + u[:half]
        a, b, c = (fuzzyhash.fingerprint(x.encode()) for x in (t, changed, u))
        want[d] = (d, len(t), hashlib.sha256(changed.encode()).hexdigest(), a, b, fuzzyhash.likeness(a, b), fuzzyhash.likeness(a, c))
    assert len(got) == len(texts)
    assert [r for r in got if r[0] not in (None, 6, 92)] == sorted((w for d, w in want.items() if d not in (None, 6, 92)), key=str)
    assert sorted(r[1] for r in got if r[0] is None) == [0, 5]


def test_the_last_document_meets_the_first(spark):
    rows = [(k, WORDS[k] * 9) for k in range(20)]
    got = fuzzyhash.with_edited(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    mark = {k: fuzzyhash.fingerprint(t.encode()) for k, t in rows}
    for r in got:
        after = (r.doc_id + 1) % 20
        text = fuzzyhash.edited(rows[r.doc_id][1], rows[after][1])
        assert r.edited_sha256 == hashlib.sha256(text.encode()).hexdigest() and r.near_next == fuzzyhash.likeness(mark[r.doc_id], mark[after])
    assert len(got) == 20


def test_one_document_is_its_own_next_and_none_give_none(spark, docs):
    one = fuzzyhash.with_edited(spark.createDataFrame([(3, "abcdef")], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.n_chars, r.edited_sha256) for r in one] == [(3, 6, hashlib.sha256(b"abcabc").hexdigest())]
    assert fuzzyhash.with_edited(docs.limit(0)).collect() == []


def test_fingerprint_column_keeps_rows_and_columns(docs, texts):
    out = fuzzyhash.fingerprints(docs)
    assert out.columns == [*docs.columns, "fingerprint_"] and out.count() == len(texts)
    mark = {fuzzyhash.fingerprint((t or "").encode()) for _, t in texts}
    assert {r[0] for r in out.select("fingerprint_").collect()} == mark
    near = out.select(fuzzyhash.alike(F.col("fingerprint_"), F.col("fingerprint_")).alias("x"), fuzzyhash.alike(F.col("fingerprint_"), F.lit(None).cast("string")).alias("y")).distinct().collect()
    assert [tuple(r) for r in near] == [(1.0, None)]


def plain_runs(w):
    """All periods one after another; a stretch belongs to the least."""
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def test_runs_of_random_words_are_those_of_the_plain_search():
    r = random.Random(3)
    seen = 0
    for _ in range(500):
        many = []
        for _ in range(r.randint(1, 4)):
            letters = r.choice([1, 2, 2, 3, 5, 50])
            w = [b"%d" % r.randrange(letters) for _ in range(r.choice([0, 1, 5, 8, 20, 60, 150, 300]))]
            for _ in range(r.randint(0, 3)):
                if w:
                    s = r.randrange(len(w))
                    p = r.randint(1, max(1, (len(w) - s) // r.choice([3, 4, 5, 9])))
                    for i in range(s, r.randint(s, len(w))):
                        w[i] = w[s + (i - s) % p]
            many.append(w)
        got = runs.runs_of(many)
        assert got == [plain_runs(w) for w in many]
        seen += sum(map(len, got))
    assert seen > 1000


def test_runs_within_runs_are_found():
    inner = [b"a"] * 7 + [b"b"]
    w = (inner * 5 + [b"c"]) * 6 + [b"d"] * 6
    assert runs.runs_of([w]) == [plain_runs(w)] and len(plain_runs(w)) > 6
    fib, next_fib = [b"a"], [b"a", b"b"]
    while len(fib) < 900:
        fib, next_fib = next_fib, next_fib + fib
    assert runs.runs_of([fib * 5]) == [plain_runs(fib * 5)]


def test_digests_of_planted_documents_are_those_of_a_plain_version(docs, texts, spark):
    got = sorted((tuple(r) for r in runs.digests(runs.with_planted_period(docs)).collect()), key=str)
    want = []
    for d, t in texts:
        w = (t or "").encode().split()
        h = None if d is None else zlib.crc32(str(d).encode())
        if h is not None and h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        found = plain_runs(w) if len(w) < 5000 else runs.runs_of([w])[0]
        kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in found)]
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None, None, None)
        milli = 1000 * best[1] // best[2] if found else None
        text = "".join("%d,%d,%d\n" % r for r in found)
        want.append((d, len(found), *best, milli, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()))
    assert got == sorted(want, key=str)
    assert sum(zlib.crc32(str(d).encode()) % 10 == 0 for d, t in texts if d is not None and t) > 5
    assert runs.digests(runs.with_planted_period(docs.limit(0))).collect() == []


def plain_negatives(rows, k=5):
    rows = {d: (label, [int(np.floor(256 * float(x))) for x in v]) for d, label, v in reversed(rows)}
    out = []
    for a, (label, v) in rows.items():
        if a % 100:
            continue
        score = {d: sum(x * y for x, y in zip(v, w, strict=False)) for d, (_, w) in rows.items() if d != a}
        first = sorted((d for d in score if rows[d][0] == label), key=lambda d: (-score[d], d))[:k]
        for p in first:
            near = sorted((d for d in score if rows[d][0] != label and 80 * score[p] <= 100 * score[d] <= 100 * score[p]), key=lambda d: (-score[d], d))[:k]
            out += [(a, p, n + 1, d, score[p], score[d]) for n, d in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["spread", "copies", "near", "large"])
def test_negatives_are_those_of_brute_force(spark, kind, monkeypatch):
    monkeypatch.setattr(negatives, "SUBTREE", 300)
    monkeypatch.setattr(negatives, "LEAF", 16)
    r = np.random.default_rng(7)
    n = 1500 if kind != "large" else 250
    v = r.normal(size=(n, 6))
    if kind == "copies":
        v[r.random(n) < 0.5] = v[3]
    if kind == "near":
        v = v[r.integers(0, 12, n)] + 0.02 * r.normal(size=v.shape)
    if kind == "large":
        v = np.floor(v * 3) * 2.0**20
    rows = [(k, int(r.integers(0, 4)), [float(x) for x in row[: 6 - k % 2]]) for k, row in enumerate(v)]
    odd = [(None, 1, [1.0]), (200_000, None, [1.0]), (200_100, 1, None), (200_200, 1, [1.0, None]), (200_300, 2, [float("nan")]), (200_400, 2, [float("inf")]), (5, 99, [9e9])]
    frame = spark.createDataFrame(rows + rows[:40] + odd, "vec_id long, label int, embedding array<double>").select("*", *[F.lit(1).alias(c) for c in CLASH])
    got = [tuple(x) for x in negatives.mine(frame, F.col("vec_id") % 100 == 0).collect()]
    assert sorted(got) == plain_negatives(rows) and got
    if kind == "spread":
        assert negatives.mine(frame.limit(0), F.col("vec_id") % 100 == 0).collect() == []


def test_shells_that_miss_the_annulus_are_not_visited(monkeypatch):
    r = np.random.default_rng(1)
    points = np.floor(256 * (r.normal(size=(40, 8))[r.integers(0, 40, 8000)] + 0.01 * r.normal(size=(8000, 8))))
    square = float((points * points).sum(1).max())
    tree = negatives.Tree.unpacked(negatives.Tree.grown(np.arange(8000), np.zeros(8000, np.int64), points, square).packed())
    seen = []
    compare = negatives.Queries._compare
    monkeypatch.setattr(negatives.Queries, "_compare", lambda self, alive, tree, a, b: seen.append(len(alive) * (b - a)) or compare(self, alive, tree, a, b))
    ids = np.arange(0, 8000, 100)
    block = negatives.Queries(ids, np.zeros(80, np.int64), np.full(80, negatives.LOW), np.full(80, negatives.HIGH), points[ids], True, 5)
    block.search(tree, np.zeros(80))
    score = (points[ids] @ points.T).astype(np.int64)
    score[np.arange(80), ids] = negatives.LOW + 1
    for q in range(80):
        assert block.id[q].tolist() == np.lexsort((np.arange(8000), -score[q]))[:5].tolist()
    assert sum(seen) < 0.5 * 80 * 8000


# --- line dedup by deletion neighbourhoods ------------------------------------------------------

def word_edits(words, edits, r):
    words = list(words)
    for _ in range(edits):
        at, how = r.randrange(len(words)), r.choice("rid")
        words[at : at + (how != "i")] = [] if how == "d" else [f"new{r.randrange(10**6)}"]
    return words


def plain_gone(lines):
    """Numbers of the lines that are equal to, or within the bound of, an earlier one."""
    return {i for i, a in enumerate(lines) if any(abs(len(a) - len(b)) * 5 <= max(len(a), len(b)) and edits(a, b) <= max(len(a), len(b)) // 5 for b in lines[:i])}


def test_lines_found_by_deletion_neighbourhoods(spark):
    """All one-word edits of short lines, and 19 in 20 of lines that were changed at random up to one word in five."""
    r = random.Random(9)
    base = [[f"w{r.randrange(4000)}" for _ in range(r.choice([1, 3, 4, 5, 6, 8, 9, 10, 11, 14, 20, 36, 50]))] for _ in range(150)]
    every = base + [word_edits(w, r.randint(0, len(w) // 4 + 1), r) for w in base for _ in range(3)]
    every = [w for w in every if w]
    r.shuffle(every)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(every)], "doc_id long, text string").repartition(5)
    got, want = {x.doc_id for x in linededup.neighbours(linededup.ready(spark) and docs).collect()}, plain_gone(every)
    assert got <= want and len(got) >= 0.95 * len(want) and len(want) > 150
    assert {i for i in want if len(every[i]) <= linededup.SHORT} == {i for i in got if len(every[i]) <= linededup.SHORT}


def long_lines():
    r = random.Random(4)
    base = [[f"w{r.randrange(4000)}" for _ in range(r.choice([20, 25, 30, 40]))] for _ in range(120)]
    every = base + [word_edits(w, len(w) // 5, r) for w in base for _ in range(2)]
    r.shuffle(every)
    return every


def test_the_query_and_the_pipeline_drop_all_long_lines_within_the_bound(spark, tmp_path):
    """Lines with as many edits as may be, of which some share none of their least keys with the earlier line."""
    import corpus_pipeline

    every = long_lines()
    want = plain_gone(every)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(every)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id for x in queries.QUERIES["op7_line_dedup"](spark, str(tmp_path)).where("n_dropped > 0").select("doc_id").collect()}
    staged = {x.doc_id for x in corpus_pipeline.line_dedup(spark, docs, str(tmp_path)).where("text = ''").select("doc_id").collect()}
    assert got == want and staged == want and len(want) > 150


def test_recall_on_whole_documents(spark):
    docs = linededup.ready(spark) and spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((x.doc_id, j, line.split()) for x in docs.collect() for j, line in enumerate((x.text or "").encode().split(b"\n")) if line.split())
    lines = [x[2] for x in rows]
    want = {rows[i][:2] for i, a in enumerate(lines) if any(abs(len(a) - len(b)) * 5 <= max(len(a), len(b)) and linededup.within_one(a, b) for b in lines[:i])}
    got = {(x.doc_id, x.line) for x in linededup.neighbours(docs).collect()}
    assert got <= want and len(got) >= 0.99 * len(want)


def test_neighbourhoods_of_odd_rows(spark, docs, texts, monkeypatch):
    exact = linededup.deduplicate(docs, least=1)
    want = sorted(((x.doc_id, x.text) for x in exact.collect()), key=str)
    for bits in (linededup.MAP_BITS, 1):
        # with maps of no size all goes through the joins
        monkeypatch.setattr(linededup, "MAP_BITS", bits)
        out = linededup.deduplicate(docs, least=1, exact=False)
        assert out.columns == docs.columns and sorted(((x.doc_id, x.text) for x in out.collect()), key=str) == want
        assert linededup.deduplicate(docs.limit(0), least=1, exact=False).count() == 0
    report = linededup.deduplicate(docs.select("doc_id", "text"), report=True, least=1, exact=False)
    assert report.columns == ["doc_id", "n_lines", "n_dropped", "text"] and report.count() == len(texts)


def test_a_map_holds_what_it_was_given(spark):
    hashes = [0, 1, -1, 2**62, -(2**63), 32768, 32767, 12345678901]
    bits = linededup._map(spark.createDataFrame([(h,) for h in hashes], "h long"), len(hashes))
    assert bits.there(np.array(hashes)).all() and bits.there(np.arange(10**6, 2 * 10**6) * 0x9E3779B97F4A7).mean() < 0.01


# --- pages of any form --------------------------------------------------------------------------

MILLION = 1_000_000


def repeated(text):
    return (text * (MILLION // len(text) + 1))[:MILLION]


@pytest.mark.parametrize("name, page", [
    ("open tags", repeated('<a "x" ')), ("both quotes", repeated("<a '\" ")), ("crossed quotes", repeated('<a "<b \'') + ">"), ("declarations", repeated("<!x ")), ("comments", repeated("<!-- x ")),
    ("wide spans", "<table>" + ("<tr>" + "<td colspan=1000 rowspan=65534>x</td>" * 20 + "</tr>") * 200 + "</table>"), ("spans", "<table>" + repeated("<tr><td rowspan=65534>x")),
    ("many spans", "<table>" + repeated("<tr><td rowspan=2>x<td>y<td colspan=3 rowspan=3>z")), ("lists", repeated("<ul><li>x")), ("quotations", repeated("<blockquote>x")), ("inline", repeated("<q>")),
    ("reference", "&#" + "1" * MILLION + ";"), ("attributes", "<a " + repeated("x=' ") + ">t"),
])
def test_long_pages_take_no_more_than_their_length(name, page):
    began = time.process_time()
    htmltext.render(page)
    assert time.process_time() - began < 12, name


def test_numbers_of_any_form():
    page = '<ol start="--5"><li>a</ol><ol start="²"><li value="--5">b<li value="' + "9" * 5000 + '">c<li value="-3">d</ol><table><tr><td colspan="²" rowspan="' + "1" * 5000 + '">x<td>y</table>&#0065;&#' + "9" * 5000 + ";&#x41;"
    assert htmltext.render(page) == "1. a\n\n1. b\n2. c\n-3. d\n\nx  y\n\nA�A"


def test_spans_are_those_of_cells_marked_one_by_one():
    r = random.Random(4)
    for _ in range(300):
        rows = [[(r.choice(["", "a", "bb", "c\ndd"]), r.choice([1, 1, 2, 3]), r.choice([1, 1, 2, 4])) for _ in range(r.randrange(4))] for _ in range(r.randrange(1, 7))]
        taken, placed, width = set(), [], {}
        for number, row in enumerate(rows):
            at, cells = 0, []
            for text, columns, down in row:
                while (number, at) in taken:
                    at += 1
                cells.append((at, text.split("\n")))
                if columns == 1:
                    width[at] = max(width.get(at, 0), *map(len, text.split("\n")))
                taken |= {(number + d, at + c) for d in range(1, down) for c in range(columns)}
                at += columns
            placed.append(cells)
        begin = lambda c: sum(w + 2 for x, w in width.items() if x < c)  # noqa: B023, E731
        want = []
        for cells in placed:
            for k in range(max((len(t) for _, t in cells), default=0)):
                line = ""
                for c, t in cells:
                    if k < len(t) and t[k]:
                        line = line.ljust(begin(c)) + ("  " if len(line) > begin(c) else "") + t[k]
                want.append(line)
        assert htmltext.grid(rows) == want, rows


def plain_render(node, depth=0):
    """Blocks, lists and inline text of a small tree, by recursion: a list of lines."""
    kind, children = node
    lines, line = [], []

    def flush():
        if line:
            lines.append(" ".join(line))
            line.clear()

    number = 0
    for child in children:
        if isinstance(child, str):
            line.append(child)
        elif child[0] == "b":
            line.extend(w for x in plain_render(child) for w in [x])
        elif child[0] == "gone":
            continue
        elif child[0] == "li":
            flush()
            number += 1
            bullet = f"{number}. " if kind == "ol" else "- "
            inner = plain_render(child)
            lines += [(bullet if k == 0 else " " * len(bullet)) + x for k, x in enumerate(inner)] or [bullet.rstrip()]
        else:
            flush()
            lines += plain_render(child)
    flush()
    return lines


def written(node, r):
    kind, children = node
    inner = "".join(f"{c} " if isinstance(c, str) else written(c, r) for c in children)
    tag = {"gone": "div hidden"}.get(kind, kind)
    close = "" if kind == "li" and r.random() < 0.5 else f"</{tag.split()[0]}>"
    return f"<{tag}>{inner}{close}" + (" " if kind == "b" else "")


def test_small_trees_are_rendered_as_by_recursion():
    r = random.Random(8)

    def grown(kind, depth):
        if kind in ("ul", "ol"):
            return kind, [grown("li", depth + 1) for _ in range(r.randint(1, 3))]
        if kind == "b":
            return kind, [r.choice(["x", "yy"])]
        words = [r.choice(["one", "two", "three"]) for _ in range(r.randint(1, 2))]
        kinds = ["b", "b", "gone"] if kind == "li" else ["b", "gone", *(["div", "div", "ul", "ol"] if depth < 3 else [])]
        return kind, words[:1] + [grown(r.choice(kinds), depth + 1) for _ in range(r.randint(0, 3))] + words[1:]

    for _ in range(300):
        node = grown("div", 0)
        # lists stand apart from what is around them by a blank line
        got = [x for x in htmltext.render(written(node, r)).split("\n") if x]
        assert got == [x for x in plain_render(node) if x], written(node, r)


# --- language model -----------------------------------------------------------------------------

@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_documents_held_out_are_likelier_than_by_their_words_alone(spark, sf):
    rows = maxent.score(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"))
    both = rows.where("held_out").agg(F.sum("base_score").alias("base"), F.sum("score").alias("model"), F.avg((F.col("score") > F.col("base_score")).cast("int")).alias("better")).first()
    assert both.model > both.base + 0.01 * abs(both.base) and both.better > 0.9


def test_model_scores_are_those_of_a_plain_version(spark):
    """The score of each text from the fitted weights, token by token with whole tables."""
    texts = {k: t for k, t in enumerate(["a b c. a b c.", "b c a, Ünd b a", "", None, "new words a b", "a a a b b c. x1 x2", "c. b a é", *["a b c. d, e f!"] * 12])}
    docs = maxent.ready(spark).createDataFrame(list(texts.items()), "doc_id long, text string")
    table, known = maxent.coded(maxent.stored(spark, maxent.blocks(docs), "word-blocks"))
    weights, bias = maxent.train(table, known)
    lower = lambda t: "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in t or "")
    words = {k: [*lower(t).split(), ""] for k, t in texts.items()}
    counts = {}
    for k, w in words.items():
        if zlib.crc32(str(k).encode()) % 7 != 2:
            for x in w:
                counts[x] = counts.get(x, 0) + 1
    total = sum(counts.values())
    top = sorted(counts, key=lambda x: (-counts[x], x))[: maxent.OWN]

    def kind(x):
        if x in top:
            return top.index(x)
        last = 0 if x[-1:] in ".!?" and x else 1 if x[-1:] in ",;:" and x else 2 if x and x[-1] < "\x7f" and x[-1] > " " and not x[-1].isalnum() else 3
        return maxent.OWN + (last * 2 + any(c > "\x7f" for c in x)) * maxent.STRATA + (counts.get(x, 0) * 1_000_000 >= total)

    share = {}
    for x, c in counts.items():
        share[kind(x)] = share.get(kind(x), 0) + c + 1
    for k in range(maxent.OWN, maxent.CLASSES, maxent.STRATA):
        share[k] = share.get(k, 0) + 1

    def bucket(x):
        import xxhash

        return np.uint64(xxhash.xxh64_intdigest(x.encode(), 42)).astype(np.int64).item() % (maxent.BUCKETS - 1) + 1

    for row in maxent.score(docs).collect():
        score = 0.0
        for i, x in enumerate(words[row.doc_id]):
            before = [bucket(words[row.doc_id][i - b]) if i >= b else 0 for b in (1, 2, 3)]
            rows = [before[0], maxent.BUCKETS + before[1], 2 * maxent.BUCKETS + before[2], 3 * maxent.BUCKETS + (before[0] * 40503 + before[1] * 9973) % maxent.PAIRS]
            scores = bias.astype(float) + sum(weights[:, r].astype(float) for r in rows)
            own = kind(x)
            score += (scores[own] - np.log(np.exp(scores - scores.max()).sum()) - scores.max()) / np.log(10) + np.log10((counts.get(x, 0) + 1) / share[own])
        assert abs(score - row.score) < 1e-3 * max(1, abs(score)), row


# --- top k --------------------------------------------------------------------------------------

def test_top_k_of_large_components_and_repeated_ids(spark):
    rows = [(0, [1e30, 1.0]), (0, [0.5, 2.0]), (50, [2.0, 2.0]), (1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [0.25, 0.25])]
    got = [tuple(r) for r in topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    big = 2**63 - 1
    # the query of the repeated id is its least vector
    assert got == [(0, 1, 1, big), (0, 2, 50, 327680), (0, 3, 3, 40960), (0, 4, 2, -big - 1), (50, 1, 0, big), (50, 2, 1, big), (50, 3, 0, 327680), (50, 4, 3, 65536), (50, 5, 2, -big - 1)]


@pytest.mark.parametrize("texts_", [["a b"], ["one two three four five"], ["w " * 40], ["", " \n "], [None], ["a\nb c d e f\n" + "x y z " * 9]])
def test_lines_of_one_kind_only(spark, texts_):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts_ * 2)], "doc_id long, text string").coalesce(1)
    gone = [tuple(r) for r in linededup.neighbours(linededup.ready(spark) and docs).select("doc_id", "line").collect()]
    lines = [(j, x) for j, x in enumerate((texts_[0] or "").split("\n")) if x.split()]
    assert sorted(gone) == [(len(texts_), j) for j, _ in lines] or len(texts_) > 1 and not gone
