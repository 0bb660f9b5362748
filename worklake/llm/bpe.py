"""BPE encoding and decoding as a tokenizer file asks, with long texts encoded in parts by tree concatenation.

Texts of up to LEAF characters are encoded where they lie. A longer one is cut into leaves at any character; the leaves are encoded in
parallel and then joined pair by pair, as a tree. At each join, the last pre-tokens of the left and the first of the right part are cut
anew as one text. The window grows until its first pre-token is the left part's and its last two are the right part's; then nothing
outside of it can change. A long pre-token that runs over the join is joined the same way by its tokens: tokens around the join are
merged anew until the window's first and last token are what the parts have there. Every two neighbouring tokens of the result are then
neighbours in some proper encoding, which makes the whole proper.

Null or empty text: no tokens, hashes of the empty string. Null ids and repeated rows: each row by itself. No rows: no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worklake.llm.common import map_texts, query, table

LEAF = 32_768  # characters of a leaf
CACHED = 700_000  # pre-tokens a worker remembers
SHORT = 64  # characters of a pre-token that is remembered
LONG = 512  # characters of a pre-token that is joined by its tokens
WINDOW = 8  # pre-tokens, or tokens, on each side of a join at first

# The pre-tokens of byte-level BPE vocabularies, and the characters which every Unicode version puts in one class. Texts
# with other characters are cut by the tokenizers library itself, which has a Unicode version of its own.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# Letters here are what re calls word characters but digits and _; re is faster.
EUROPEAN = re.compile("[\\t\\n\\r -~\u00bf-\u0233\u2010-\u2027\u20ac]*")
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
STABLE = regex.compile("[\\x00-\\u0557\\u0590-\\u088e\\u0900-\\u0bff\\u2000-\\u206f\\u20a0-\\ua7cd\\uac00-\\ud7a3\\U0001f300-\\U0001f6cf]*+")


@dataclass
class Part:
    """An encoded part of a text: ends of the pre-tokens in it, their token ids, and how many ids each has."""
    text: str
    ends: list[int]
    ids: list[int]
    counts: list[int]


class Codec:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.special = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        self.at_special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes whose sign in the vocabulary is the character itself
        signs = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        self.sign_of, self.byte_of = signs, {c: b for b, c in signs.items()}
        self.cache: dict[str, tuple[str, int, str]] = {}
        self.bytes: dict[int, bytes] = {}

    # pre-tokens

    def cut(self, text: str) -> list[str]:
        """The pre-tokens of a text, special tokens among them."""
        if self.at_special is None or not any(s in text for s in self.special):
            return self._cut(text)
        return [p for part in self.at_special.split(text) if part for p in ([part] if part in self.special else self._cut(part))]

    def _cut(self, text: str) -> list[str]:
        if EUROPEAN.fullmatch(text):
            return WORDS.findall(text)
        if STABLE.fullmatch(text):
            return PATTERN.findall(text)
        return [text[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(text)]

    # tokens

    def token_bytes(self, i: int) -> bytes:
        got = self.bytes.get(i)
        if got is None:
            sign = self.tok.id_to_token(i)
            got = self.bytes[i] = sign.encode() if sign in self.special else bytes(self.byte_of[c] for c in sign)
        return got

    def ids_of(self, pres: list[str]) -> list[list[int]]:
        """The ids of each pre-token."""
        return [e.ids for e in self.tok.encode_batch_fast(pres, add_special_tokens=False)]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.token_bytes, ids)).decode("utf-8", "replace")

    def merged(self, data: bytes) -> list[int]:
        """The ids of bytes taken as one pre-token."""
        return [t.id for t in self.tok.model.tokenize("".join(map(self.sign_of.__getitem__, data)))]

    # whole texts

    def known(self, pres: list[str]) -> list[tuple[str, int, str]]:
        """(ids joined by commas, number of ids, decoded text) of each pre-token."""
        cache = self.cache
        if len(cache) > CACHED:
            cache.clear()
        new = list({p for p in pres if p not in cache})
        found = {}
        for a in range(0, len(new), 4096):
            for p, ids in zip(new[a:a + 4096], self.ids_of(new[a:a + 4096])):
                decoded = self.decode(ids)
                (cache if len(p) <= SHORT else found)[p] = (",".join(map(str, ids)), len(ids), p if decoded == p else decoded)
        return [cache.get(p) or found[p] for p in pres] if found else [cache[p] for p in pres]

    def encoded(self, text: str) -> tuple[int, str, str]:
        """Number of ids, the ids joined by commas, the decoded text."""
        got = self.known(self.cut(text))
        return sum(g[1] for g in got), ",".join([g[0] for g in got]), "".join([g[2] for g in got])

    # parts

    def part(self, text: str, pres: list[str] | None = None) -> Part:
        pres = self.cut(text) if pres is None else pres
        got = self.known(pres)
        joined = ",".join([g[0] for g in got])
        return Part(text, list(accumulate(map(len, pres))), list(map(int, joined.split(","))) if joined else [], [g[1] for g in got])

    def joined(self, a: Part, b: Part) -> Part:
        """The encoding of a's and b's text as one."""
        if not a.ends or not b.ends:
            return a if a.ends else b
        size, cut, wide = len(a.text), len(a.ends), WINDOW
        while True:
            i, k = max(0, cut - wide), min(len(b.ends), wide)
            start, stop = a.ends[i - 1] if i else 0, b.ends[k - 1]
            pres = self.cut(a.text[start:] + b.text[:stop])
            left = not i or len(pres[0]) == a.ends[i] - start
            right = k == len(b.ends) or [len(p) for p in pres[-2:]] == [b.ends[k - 2] - b.ends[k - 3], stop - b.ends[k - 2]]
            if left and right:
                break
            wide *= 2
        ends, ids, counts, here = a.ends[:i], a.ids[:sum(a.counts[:i])], a.counts[:i], start
        for p in pres:
            own = self._across(p, here, a, b, size) if len(p) > LONG and here < size < here + len(p) else None
            own = own or self.ids_of([p])[0]
            here += len(p)
            ends.append(here)
            ids += own
            counts.append(len(own))
        skip = sum(b.counts[:k])
        return Part(a.text + b.text, ends + [e + size for e in b.ends[k:]], ids + b.ids[skip:], counts + b.counts[k:])

    def _across(self, p: str, here: int, a: Part, b: Part, size: int) -> list[int] | None:
        """Ids of a pre-token over the join, from the last pre-token of a and the first of b if they are its two halves."""
        if here != (a.ends[-2] if len(a.ends) > 1 else 0) or here + len(p) != size + b.ends[0] or p in self.special:
            return None
        return self.tokens_joined(a.ids[len(a.ids) - a.counts[-1]:], b.ids[:b.counts[0]])

    def tokens_joined(self, a: list[int], b: list[int]) -> list[int]:
        wide = WINDOW
        while True:
            left, right = a[-wide:], b[:wide]
            ids = self.merged(b"".join(map(self.token_bytes, left + right)))
            whole_left, whole_right = len(left) == len(a), len(right) == len(b)
            if (whole_left or ids[0] == left[0]) and (whole_right or ids[-1] == right[-1]) and (len(ids) > 1 or whole_left and whole_right):
                return a[:len(a) - len(left)] + ids + b[len(right):]
            wide *= 2

    def tree(self, parts: list[Part]) -> Part:
        while len(parts) > 1:
            pairs = [self.joined(parts[i], parts[i + 1]) for i in range(0, len(parts) - 1, 2)]
            parts = pairs + parts[len(parts) // 2 * 2:]
        return parts[0] if parts else Part("", [], [], [])


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec a worker and path."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def leaves(long: DataFrame, leaf: int) -> DataFrame:
    """rid, doc_id, k, text: the leaves of each text, cut in one pass over it and spread over the tasks."""
    rows = long.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")  # before the leaves: one number a row
    cut = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{leaf}}}"), F.lit(0))
    return rows.select("rid", "doc_id", F.posexplode(cut).alias("k", "text"))


ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, leaves int"


def encode_decode(docs: DataFrame, path: str, leaf: int = LEAF, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, leaves of every document; with ids also the ids and the decoded text."""
    docs = docs.select("doc_id", "text")
    is_long = F.char_length(F.coalesce("text", F.lit(""))) > leaf
    schema = ENCODED + (", ids array<int>, decoded string" if ids else "")

    def row(n: int, joined: str, decoded: str, parts: int) -> tuple:
        return (n, sha(joined), sha(decoded), parts) + ((list(map(int, joined.split(","))) if n else [], decoded) if ids else ())
    names = [f.split()[0] for f in schema.split(", ")][1:]

    def short():
        c = codec(path)

        def fn(cols):
            made = [row(*c.encoded(t), 1) for t in cols["text"]]
            return {"doc_id": cols["doc_id"]} | dict(zip(names, zip(*made)))
        return fn

    def leaf_parts():
        c = codec(path)

        def fn(cols):
            parts = [c.part(t) for t in cols["text"]]
            return {"rid": cols["rid"], "doc_id": cols["doc_id"], "k": cols["k"], "part": cols["text"], "ends": [p.ends for p in parts],
                    "ids": [p.ids for p in parts], "counts": [p.counts for p in parts]}
        return fn

    def join(group: pa.Table) -> pa.Table:
        c, cols = codec(path), group.to_pydict()
        order = sorted(range(len(cols["k"])), key=cols["k"].__getitem__)
        whole = c.tree([Part(cols["part"][i], cols["ends"][i], cols["ids"][i], cols["counts"][i]) for i in order])
        made = row(len(whole.ids), ",".join(map(str, whole.ids)), c.decode(whole.ids), len(order))
        types = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.string()]
        return pa.table([pa.array([cols["doc_id"][0]], pa.int64())] + [pa.array([v], t) for v, t in zip(made, types)], ["doc_id", *names])

    plain = map_texts(docs.where(~is_long), short, schema)
    cut = map_texts(leaves(docs.where(is_long), leaf).repartition("rid", "k"), leaf_parts,
                    "rid long, doc_id long, k int, part string, ends array<int>, ids array<int>, counts array<int>")
    return plain.unionByName(cut.groupBy("rid").applyInArrow(join, schema))


def vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


@query("op1_bpe")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), vocabulary())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its token ids and the text they stand for."""
    return encode_decode(docs, vocabulary(), ids=True)
