"""Token counts without ids: pieces are counted once per distinct pre-token and joined to per-document frequencies.

A text is normalised and split as the tokenizer's own file says.  Each document's pre-tokens become a frequency table;
the number of pieces of a distinct pre-token comes from the tokenizer once per worker (a bounded dictionary) and the
two are joined and summed.  The join stays inside the task: dealing (document, pre-token) pairs out over the cluster
would move more bytes than the texts have, to save a dictionary lookup.

The normaliser and splitter of the library are used as they are for texts with characters beyond U+024F (or U+0130,
whose lower case has two characters); below that lower-casing and NFC are the same in Python, and the split pattern
runs on the text itself, which is much faster.

Cases: null or empty text: 0 bytes, 0 tokens, not over the limit.  Strings of special tokens inside a text count as
that one token each, as in the library's default.  Repeated rows: one result each.  Empty table: empty result.
Columns of the input other than doc_id are not returned.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import tune

#: Distinct pre-tokens that a worker remembers before it starts afresh.
MAX_PRETOKENS = 200_000
LONG_TEXT = 1 << 20


class PieceCounts(dict):
    """Pre-token -> number of its pieces."""

    def __init__(self, count):
        super().__init__()
        self.count = count

    def __missing__(self, pretoken: str) -> int:
        if len(self) >= MAX_PRETOKENS:
            self.clear()
        n = self.count(pretoken)
        if len(pretoken) < 200:
            self[pretoken] = n
        return n


class TokenCounter:
    """Counts the tokens of texts for one tokenizer file of the tokenizers library with a Split pre-tokenizer."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        spec = json.loads(self.tok.to_str())
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]))
        splits = [s for s in spec["pre_tokenizer"]["pretokenizers"] if s["type"] == "Split"]
        lowers = [n["type"] for n in spec["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"]
        self.plain = len(splits) == 1 and splits[0]["invert"] and splits[0]["behavior"] == "Removed" and lowers
        self.split = regex.compile(splits[0]["pattern"]["Regex"]) if self.plain else None
        self.wide = regex.compile("[^\x00-ɏ]|İ")
        self.known = PieceCounts(lambda p: len(self.tok.encode(p, add_special_tokens=False).ids))
        self.known_wide = PieceCounts(lambda p: len(self.tok.model.tokenize(p)))

    def _pretokens(self, text: str) -> Iterator[list[str]]:
        text = text.lower()
        if len(text) < LONG_TEXT:
            yield self.split.findall(text)
            return
        found = (m.group() for m in self.split.finditer(text))
        while block := list(islice(found, 100_000)):
            yield block

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        n = 0
        if "<|" in text:
            n = len(self.special.findall(text))
            parts = self.special.split(text) if n else [text]
        else:
            parts = [text]
        for part in parts:
            if self.plain and not self.wide.search(part):
                blocks, known = self._pretokens(part), self.known
            else:
                blocks, known = [[p for p, _ in self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(part))]], self.known_wide
            for block in blocks:
                frequencies = Counter(block)
                n += sum(map(int.__mul__, map(known.__getitem__, frequencies), frequencies.values()))
        return n


_counters: dict[str, TokenCounter] = {}


def count_tokens(df: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of df (doc_id, text)."""
    id_type = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _counters:
            _counters[path] = TokenCounter(path)
        count = _counters[path]
        for batch in batches:
            rows = batch.column(1).to_pylist()
            tokens = [count(t) for t in rows]
            sizes = [len(t.encode()) if t else 0 for t in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    tune(df.sparkSession)
    return df.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
