"""Token counts of whole texts, huge ones by overlapping chunks that are resynchronised.

Counts are those of the vocabulary file's own library, without begin, end or added
special tokens; a special token's string inside a text counts as the library's default
has it. Null text counts as empty (0 tokens).

Texts up to CHUNK characters are encoded as units: white space and what follows it up to
the next white space. A byte-level pre-tokenizer never joins a character to white space
on its right, so a unit's tokens don't depend on its neighbours, and counts of units
are remembered. Texts with other than ASCII white space are left to the library whole.

Longer texts are cut into overlapping chunks, each encoded by the library with offsets.
Two chunks are spliced at a place in their overlap where both begin a new pre-token:
the pre-tokenizer works from left to right and looks ahead, never back, so from such a
place on the right chunk's tokens are those of the whole text, and before it the left
chunk's are, as long as it is GUARD characters from the left chunk's end (what a
cut can change: the last pre-tokens and a cut special string). Where there is no such
place, the overlap is widened, in the end to the whole rest of the text.
"""

from __future__ import annotations

import json
import os
import re
from collections import ChainMap
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts

#: Characters of a chunk; texts up to this length are not cut.
CHUNK = 32_768
#: Characters of the first overlap.
OVERLAP = 256
#: Units whose counts a task remembers; the first ones, as frequent units come early.
REMEMBERED = 600_000

_UNIT = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
#: White space to Unicode, or to Python, outside the six ASCII characters.
_OTHER_SPACE = re.compile("[^ \t-\r\\S]|[\x1c-\x1f\x85\xa0\u180e\u200b\u2060\ufeff]")


class Counter:
    """Counts tokens by a tokenizers file whose pre-tokenizer is byte-level."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            kind = json.load(f).get("pre_tokenizer") or {}
        if kind.get("type") != "ByteLevel" or not kind.get("use_regex", True) or kind.get("add_prefix_space"):
            raise ValueError("boundaries are proven for byte-level pre-tokenizers only")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.guard = 64 + max(map(len, special), default=0)
        self.chunk, self.overlap = chunk, overlap
        self.known: dict[str, int] = {}

    def _whole(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _starts(self, text: str, at: int) -> tuple[list[int], dict[int, int]]:
        """Of a chunk that begins at `at`: offsets of its pre-tokens, and the tokens before each. Special strings stand for themselves."""
        found = self.tokenizer.encode(text, add_special_tokens=False)
        places: list[int] = []
        before: dict[int, int] = {}
        last = object()
        for n, (word, (start, _)) in enumerate(zip(found.word_ids, found.offsets, strict=True)):
            if word is None or word != last:
                if at + start not in before:
                    places.append(at + start)
                    before[at + start] = n
                last = word if word is not None else object()
        before[at + len(text)] = len(found)
        return places, before

    def spliced(self, text: str) -> int:
        """Tokens of a text of any length by overlapping chunks."""
        end = min(len(text), self.chunk)
        places, before = self._starts(text[:end], 0)
        left, total = 0, 0  # the place from which the current chunk counts
        while end < len(text):
            overlap = self.overlap
            while True:
                begin = max(left, end - overlap)
                until = min(len(text), begin + self.chunk + overlap)
                after, n_after = self._starts(text[begin:until], begin)
                common = [p for p in after if begin < p <= end - self.guard and p in before and p > left]
                if common:
                    break
                if begin == left:  # nothing to align in all of this chunk: the next one takes its place, and grows
                    common = [left] if left in n_after else []
                    if common and until > end:
                        break
                overlap *= 2
            splice = common[len(common) // 2]
            total += before[splice] - before[left]
            left, end, before = splice, until, n_after
        return total + before[len(text)] - before[left]

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text."""
        out, units, odd = [0] * len(texts), {}, []
        known = self.known
        for i, text in enumerate(texts):
            if not text:
                continue
            if len(text) > self.chunk:
                out[i] = self.spliced(text)
            elif _OTHER_SPACE.search(text):
                odd.append(i)
            else:
                units[i] = _UNIT.findall(text)
        new = list({u for found in units.values() for u in found if u not in known})
        fresh = dict(zip(new, self._whole(new), strict=True))
        if len(known) + len(fresh) <= REMEMBERED:
            known.update(fresh)
        else:
            known = ChainMap(known, fresh)
        for i, found in units.items():
            out[i] = sum(map(known.__getitem__, found))
        for i, n in zip(odd, self._whole([texts[i] for i in odd]), strict=True):
            out[i] = n
        return out


@lru_cache(maxsize=2)
def _counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, n_bytes (UTF-8), n_tokens, over_limit. path: the vocabulary file, at one place on all machines."""
    fields = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def counted(texts: list[str | None]) -> dict[str, pa.Array]:
        return {"n_bytes": pa.array([len((t or "").encode()) for t in texts], pa.int64()), "n_tokens": pa.array(_counter(path).counts(texts), pa.int64())}

    return map_texts(docs, [id_col], text_col, fields, counted).withColumn("over_limit", F.col("n_tokens") > limit)
