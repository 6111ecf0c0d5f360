"""Byte-level BPE by a deterministic automaton over tokens.

The merges are compiled one after another. The automaton starts as one state with a loop for every
byte. For a merge of u and v into w, every path u, v is replaced: the arcs labelled u now lead to a
copy of their target that lacks the arc v, and every state with an arc u gets an arc w that leads
where v led. All arcs with one label share one target, so a state is stored as its parent, the label it
lacks and the merge that made it; an arc exists if that chain allows it. Among all token sequences that
spell a word the automaton accepts exactly one, the one that applying the merges in order gives.

Nulls count as empty texts; an empty text has no ids. Repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtide.llm.common import ready

#: Pieces that a worker keeps with their ids; the memory is emptied beyond it.
KEPT_PIECES = 500_000
_compiled: dict[str, "Automaton"] = {}


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, others from U+0100 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    letters = [chr(b) if b in own else "" for b in range(256)]
    spare = iter(range(256, 512))
    return [x or chr(next(spare)) for x in letters]


def _classes() -> tuple[str, str, str, str]:
    """Character classes of letters, numbers and white space below U+0250, and all characters whose class is certain."""
    low = [chr(i) for i in range(0x250)]
    group = lambda kind: "".join(re.escape(c) for c in low if unicodedata.category(c).startswith(kind))
    return group("L"), group("N"), "\\t-\\r \\x85\\xa0", "\\x00-\\u024f\\u2010-\\u2027\\u2030-\\u205e\\u20ac"


LETTERS, NUMBERS, SPACE, CERTAIN = _classes()
PIECES = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACE}{LETTERS}{NUMBERS}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
UNCERTAIN = re.compile(f"[^{CERTAIN}]")


def split(text: str) -> list[str]:
    """The pieces within which merges apply.

    Texts with characters whose class depends on the Unicode version are split by the tokenizers library.
    """
    if not UNCERTAIN.search(text):
        return PIECES.findall(text)
    from tokenizers.pre_tokenizers import ByteLevel

    cut = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str(text)
    return [text[a:b] for _, (a, b) in cut]


class Automaton:
    """Compiled from the JSON of a byte-level BPE tokenizer."""

    def __init__(self, raw: bytes) -> None:
        spec = json.loads(raw)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre.get("add_prefix_space") or spec["normalizer"]:
            raise ValueError("a byte-level BPE tokenizer without normalizer and prefix space is asked for")
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        if any(x[k] for x in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens must match as they are")
        self.added = {k: v.to_bytes(4, "little") for k, v in added.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        vocab = model["vocab"]
        self.label = [b""] * (1 + max([*vocab.values(), *added.values()]))
        for letters, i in vocab.items():
            self.label[i] = bytes(byte_of[c] for c in letters)
        for content, i in added.items():
            self.label[i] = content.encode()
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self._compile([(vocab[u], vocab[v], vocab[u + v]) for u, v in merges], [vocab[c] for c in byte_of])
        self.known: dict[str, bytes] = {}

    def _compile(self, merges: list[tuple[int, int, int]], single: list[int]) -> None:
        n = len(self.label)
        self.left, self.made, self.state_of = [-1] * n, [-1] * n, [0] * n
        self.parent, self.lacks, self.born = [-1], [-1], [-1]
        self.arcs: dict[int, bool] = {}
        live = list(single)
        for k, (u, v, w) in enumerate(merges):
            if not self._has(self.state_of[u], v):
                continue  # no path u, v is left: w never appears
            self.left[w], self.made[w], self.state_of[w] = u, k, self.state_of[v]
            self.parent.append(self.state_of[u])
            self.lacks.append(v)
            self.born.append(k)
            self.state_of[u] = len(self.born) - 1
            live.append(w)
        # the tokens as a tree by their bytes; shorter: the longest token that begins the token
        self.tree: dict[int, int] = {}
        self.ends: list[int] = [-1]
        self.size, self.shorter = [len(x) for x in self.label], [-1] * n
        for t in sorted(live, key=self.size.__getitem__):
            node, before = 0, -1
            for b in self.label[t]:
                before = self.ends[node] if self.ends[node] >= 0 else before
                key = node << 8 | b
                node = self.tree.get(key, 0)
                if not node:
                    node = self.tree[key] = len(self.ends)
                    self.ends.append(-1)
            self.ends[node], self.shorter[t] = t, before

    def _has(self, state: int, token: int) -> bool:
        """Whether the state has an arc with this label."""
        while state:
            if self.made[token] >= self.born[state]:
                token = self.left[token]  # an arc made later stands where the arc of its first part stood
            elif self.lacks[state] == token:
                return False
            else:
                state = self.parent[state]
        return True

    def _longest(self, piece: bytes, at: int) -> int:
        """The longest token that begins here."""
        tree, ends, node, found = self.tree, self.ends, 0, -1
        for b in piece[at:] if len(piece) - at < 64 else memoryview(piece)[at:]:
            node = tree.get(node << 8 | b, 0)
            if not node:
                break
            if ends[node] >= 0:
                found = ends[node]
        return found

    def ids(self, piece: bytes) -> list[int]:
        """The one accepted sequence of tokens that spells the piece.

        Arcs are followed depth first, longest label first. One sequence at most spells each prefix, so a
        place that was left without success is never entered again and the walk stays linear.
        """
        size, shorter, state_of, arcs = self.size, self.shorter, self.state_of, self.arcs
        if len(arcs) > 2_000_000:
            arcs.clear()
        end, at, state, out, shut = len(piece), 0, 0, [], set()
        token = self._longest(piece, 0)
        while True:
            to = at + size[token]
            if to not in shut:
                key = state << 20 | token
                ok = arcs.get(key)
                if ok is None:
                    ok = arcs[key] = self._has(state, token)
                if ok:
                    out.append(token)
                    if to == end:
                        return out
                    at, state = to, state_of[token]
                    token = self._longest(piece, at)
                    continue
            if shorter[token] >= 0:
                token = shorter[token]
            else:
                shut.add(at)
                token = out.pop()
                at -= size[token]
                state = state_of[out[-1]] if out else 0

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        known, out = self.known, []
        if len(known) > KEPT_PIECES:
            known.clear()
        for part in self.cut.split(text) if self.cut and self.cut.search(text) else (text,):
            if part in self.added:
                out.append(self.added[part])
                continue
            for piece in split(part):
                got = known.get(piece)
                if got is None:
                    got = known[piece] = np.array(self.ids(piece.encode()), "<u4").tobytes()
                out.append(got)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        label = self.label
        return b"".join([label[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


def compiled(raw: bytes) -> Automaton:
    """One automaton for each tokenizer and worker."""
    key = hashlib.sha256(raw).hexdigest()
    if key not in _compiled:
        _compiled[key] = Automaton(raw)
    return _compiled[key]


def _raw(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` of every text; ids are little-endian unsigned 32-bit integers in one binary value.

    The tokenizer's file is read by the driver; its size is fixed, so it is sent to the workers whole.
    """
    spark = ready(docs.sparkSession)
    raw = spark.sparkContext.broadcast(_raw(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = compiled(raw.value)
        for batch in batches:
            ids = [automaton.encode(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"]
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` with the text that the ids stand for."""
    spark = ready(encoded.sparkSession)
    raw = spark.sparkContext.broadcast(_raw(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = compiled(raw.value)
        for batch in batches:
            texts = [automaton.decode(x.as_py() or b"") for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids", "text"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, text string")


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Encoded and decoded again: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    return decode(encode(docs, tokenizer), tokenizer).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256")
    )
