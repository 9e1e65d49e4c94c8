"""Token counts by prefix dynamic programming.

For a byte-pair vocabulary the tokens of a prefix are the tokens of a
shorter prefix plus one more token: the only vocabulary entry that ends at
the prefix and that stays separate from its predecessor when the two are
encoded together.  One left-to-right pass therefore gives the exact token
count at *every* prefix of a text.  The operator stores these counts as
one signed byte per code point (the change of the count), so truncation
and budget questions are answered later without encoding again.

No piece of the vocabulary holds a space mark after another character, so
words are independent; their change strings are kept in a bounded memo.

Cases: a null text counts as empty; an empty text has no tokens and no
changes; repeated rows give repeated results; further columns stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinis.llm.words import slices

MARK = "▁"  # how the vocabulary writes a space
MEMO_WORDS = 300_000  # per generation; two are kept
MEMO_PAIRS = 2_000_000
OPEN, CUT = -2, -1


class PrefixCounter:
    """Prefix counts of one SentencePiece BPE vocabulary with byte fallback."""

    def __init__(self, model: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=model)
        self.rank: dict[str, float] = {}
        for i in range(sp.get_piece_size()):
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)):
                self.rank[sp.id_to_piece(i)] = sp.get_score(i)
        if any(MARK in p.lstrip(MARK) for p in self.rank):
            raise ValueError("a piece joins words; prefix counts by word need a vocabulary without such pieces")
        # pieces by their characters; "" holds the number of the piece that ends here
        self.tree: dict = {}
        self.piece = list(self.rank)
        for number, p in enumerate(self.piece):
            node = self.tree
            for ch in p:
                node = node.setdefault(ch, {})
            node[""] = number
        alone = "" if any("\n" in p for p in self.rank) else "\n"
        self.units = re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+" + (f"|{alone}" if alone else ""))
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.whole: dict[int, bool] = {}
        self.pairs: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """Plain encoding of a short text: join the best adjacent pair until none is left."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.rank.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stands(self, number: int) -> bool:
        """True if the piece's own text is encoded as this one piece."""
        ok = self.whole.get(number)
        if ok is None:
            p = self.piece[number]
            ok = self.whole[number] = self.merged(p) == [p]
        return ok

    def apart(self, left: int, right: int) -> bool:
        """True if two pieces stay two tokens side by side."""
        if len(self.pairs) >= MEMO_PAIRS:
            self.pairs.clear()
        a, b = self.piece[left], self.piece[right]
        ok = self.pairs[left << 32 | right] = self.merged(a + b) == [a, b]
        return ok

    def changes(self, unit: str) -> bytes:
        """Change of the token count at each code point of one unit."""
        n = len(unit)
        count, last = [0] * (n + 1), [OPEN] * (n + 1)
        last[0] = CUT
        tree, pairs = self.tree, self.pairs
        for k in range(n):
            left = last[k]
            if left == OPEN:  # no piece ends here: the character is written as bytes
                count[k] = count[k - 1] + len(unit[k - 1].encode("utf-8", "surrogatepass"))
                left = last[k] = CUT
            more, node, e = count[k] + 1, tree, k
            while e < n:
                node = node.get(unit[e])
                if node is None:
                    break
                e += 1
                if last[e] == OPEN and (number := node.get("")) is not None:
                    if left == CUT:
                        ok = self.stands(number)
                    else:
                        ok = pairs.get(left << 32 | number)
                        if ok is None:
                            ok = self.apart(left, number)
                    if ok:
                        count[e], last[e] = more, number
        if last[n] == OPEN:
            count[n] = count[n - 1] + len(unit[n - 1].encode("utf-8", "surrogatepass"))
        return bytes([(b - a) & 255 for a, b in zip(count, count[1:])])

    def look_up(self, unit: str) -> bytes:
        """Changes of a unit that the younger memo lacks; words in use move up from the older one."""
        found = self.older.get(unit) or self.changes(unit)
        if len(unit) <= 64:
            if len(self.words) >= MEMO_WORDS:
                self.older, self.words = self.words, {}
            self.words[unit] = found
        return found

    def prefix_changes(self, text: str) -> bytes:
        """One signed byte per code point; the library puts a space mark before a text."""
        if not text:
            return b""
        marked = MARK + text.replace(" ", MARK)
        every = b"".join([self.words.get(u) or self.look_up(u) for u in self.units.findall(marked)])
        # the mark belongs to the first code point of the text
        return bytes([(every[0] + every[1]) & 255]) + every[2:]


@lru_cache(maxsize=2)
def counter(model: str) -> PrefixCounter:
    return PrefixCounter(model)


def total(changes: bytes) -> int:
    return int(np.frombuffer(changes, np.int8).sum(dtype=np.int64))


def prefix_token_counts(df: DataFrame, model: str, text: str = "text", out: str = "prefix_changes") -> DataFrame:
    """Adds ``out`` (binary): the change of the token count at each code point.

    The running sum up to position n is the exact count of the first n
    code points.  ``model`` is a path that every executor can read.
    """

    @F.pandas_udf(T.BinaryType())
    def changes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = counter(model)
        for b in batches:
            yield pd.Series([c.prefix_changes(t) if t is not None else b"" for t in b], dtype=object)

    return df.withColumn(out, changes(F.col(text)))


@F.pandas_udf(T.LongType())
def token_total(changes: pd.Series) -> pd.Series:
    """Tokens of the whole text."""
    return pd.Series([total(c) for c in changes], dtype="int64")


@F.pandas_udf(T.LongType())
def tokens_at(changes: pd.Series, position: pd.Series) -> pd.Series:
    """Tokens of the first ``position`` code points."""
    return pd.Series([total(c[:max(0, int(p))]) for c, p in zip(changes, position)], dtype="int64")


@F.pandas_udf(T.LongType())
def longest_prefix(changes: pd.Series, budget: pd.Series) -> pd.Series:
    """Code points of the longest prefix with at most ``budget`` tokens."""
    out = []
    for c, b in zip(changes, budget):
        fits = np.flatnonzero(np.cumsum(np.frombuffer(c, np.int8), dtype=np.int64) <= b)
        out.append(int(fits[-1]) + 1 if len(fits) and b >= 0 else 0)
    return pd.Series(out, dtype="int64")


def document_token_counts(df: DataFrame, model: str, limit: int, doc_id: str = "doc_id",
                          text: str = "text") -> DataFrame:
    """Digest per document: bytes, tokens and whether they exceed ``limit``.

    The token total is the last prefix count.  Prefix counts are made and
    summed in one pass, so the change strings do not leave the task.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model)
        for b in batches:
            column = b.column(1)
            for x, y in slices(column):
                part = column.slice(x, y - x)
                tokens = [total(c.prefix_changes(t)) if t else 0 for t in part.to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(x, y - x), pa.array(tokens, pa.int64()),
                     pc.binary_length(part).fill_null(0).cast(pa.int64())],
                    names=["doc_id", "n_tokens", "n_bytes"])

    kind = df.schema[doc_id].dataType.simpleString()
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        count, f"doc_id {kind}, n_tokens long, n_bytes long")
    return rows.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return document_token_counts(docs, str(public_tokenizers.path("piece_bpe_32k.model")), 4096)
