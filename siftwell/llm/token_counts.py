"""Exact token counts of every prefix of a text, by dynamic programming over prefixes.

For byte-pair models the encoding of a prefix is the encoding of a shorter prefix and one more
piece: the only piece ending there that the shorter prefix's last piece does not merge with. So a
count and a last piece per place are enough to go on, and the counts answer how many tokens any
prefix has and how much text a budget of tokens allows, without encoding again. Whether two pieces
stay apart is asked of the library once per pair. No piece goes on after a word end into a space
mark, so a text is the sequence of its words, and counts within words seen before are remembered.

Results for odd input: a null text counts as empty, with no tokens and no prefix; characters that no
piece has count one token per UTF-8 byte; strings such as ``<s>`` in a text are ordinary text;
repeated rows are all returned; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "▁"  # how the model writes a space
REMEMBERED, LONGEST_WORD, PAIRS = 300_000, 64, 1_000_000
ROWS = 500  # texts per batch that a task hands back


class PrefixCounter:
    """Counts for one SentencePiece model of the BPE kind."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids = {m.id_to_piece(i): i for i in range(m.get_piece_size())
                    if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) or "\n" in p for p in self.ids) or m.encode(" a", out_type=str) != [SPACE, SPACE + "a"]:
            raise ValueError("only models with leading space marks, dummy prefix and identity normalisation can be counted by words")
        self.longest = max(map(len, self.ids))
        self.lead = len(m.encode("\n"))
        self.apart: dict[int, bool] = {}
        self.known: dict[str, np.ndarray] = {}

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether a text of two pieces is encoded as these two."""
        if len(self.apart) > PAIRS:
            self.apart.clear()
        text = self.model.id_to_piece(left) + self.model.id_to_piece(right)
        known = self.apart[left << 32 | right] = self.model.encode("\n" + text)[self.lead:] == [left, right]
        return known

    def extend(self, s: str, counts: list[int], last: list[int | None]) -> None:
        """Go on from the places done, ``len(counts) - 1``, to the end of ``s``."""
        ids, apart = self.ids, self.apart
        for stop in range(len(counts), len(s) + 1):
            if s[stop - 1] not in ids:
                counts.append(counts[-1] + len(s[stop - 1].encode()))
                last.append(None)
                continue
            for start in range(stop - 1, max(-1, stop - 1 - self.longest), -1):
                piece = ids.get(s[start:stop])
                if piece is None:
                    continue
                left = last[start]
                if left is not None:
                    known = apart.get(left << 32 | piece)
                    if not (self.stay_apart(left, piece) if known is None else known):
                        continue
                counts.append(counts[start] + 1)
                last.append(piece)
                break
            else:
                raise AssertionError(f"no last piece for {s[:stop]!r}")

    def learn(self, words: set[str]) -> dict[str, np.ndarray]:
        """Counts per place of each word, sorted so that the places of a common beginning are kept."""
        found: dict[str, np.ndarray] = {}
        before, counts, last = "", [0], [None]
        for word in sorted(words):
            s = SPACE + word.replace(" ", SPACE)
            same = 0
            for x, y in zip(before, s):
                if x != y:
                    break
                same += 1
            del counts[same + 1:], last[same + 1:]
            self.extend(s, counts, last)
            found[word], before = np.array(counts[1:], dtype=np.int32), s
        return found

    def prefix_counts(self, texts: list[str]) -> list[np.ndarray]:
        """For each text the tokens of its first 1, 2, ... code points."""
        split = [self.words(t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = self.learn(set().union(*split).difference(self.known))
        self.known |= {w: c for w, c in new.items() if len(w) <= LONGEST_WORD}
        rare = {w: c for w, c in new.items() if len(w) > LONGEST_WORD}
        out = []
        for words in split:
            if not words:
                out.append(np.empty(0, dtype=np.int32))
                continue
            parts = [rare[w] if w in rare else self.known[w] for w in words] if rare else list(map(self.known.__getitem__, words))
            sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
            values = np.concatenate(parts)
            totals = values[np.cumsum(sizes) - 1]
            values += np.repeat(np.cumsum(totals) - totals, sizes).astype(np.int32)
            out.append(values[1:])  # without the place of the dummy space
        return out

    @staticmethod
    def words(text: str) -> list[str]:
        """The text cut before every run of spaces; of each run one space is left out."""
        text = text.replace(SPACE, " ")
        return text.split(" ") if "  " not in text and text[0] != " " and text[-1] != " " else [w[1:] for w in re.findall(" +[^ ]*", " " + text)]


@functools.cache
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def prefix_tokens(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, prefix_tokens)``: entry ``k`` of the last has the tokens of the first ``k + 1`` code points."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, ROWS):
                some = part.slice(at, ROWS)
                found = counter(model).prefix_counts(some.column("text").to_pylist())
                ends = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
                totals = pa.array([int(f[-1]) if len(f) else 0 for f in found], pa.int64())
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("n_bytes"), totals, lists], names=["doc_id", "n_bytes", "n_tokens", "prefix_tokens"])

    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.octet_length(whole).cast("long").alias("n_bytes"), whole.alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, prefix_tokens array<int>")


def tokens_of_prefix(prefix: Column, code_points: Column | int) -> Column:
    """Tokens of the first ``code_points`` of a text; of the whole text if it is shorter."""
    n = code_points if isinstance(code_points, Column) else F.lit(code_points)
    return F.coalesce(F.get(prefix, F.least(n, F.size(prefix)) - 1), F.lit(0))


def longest_prefix(prefix: Column, budget: Column | int) -> Column:
    """The most code points whose tokens stay within the budget; counts can fall again inside a word, and do count then."""
    within = F.transform(prefix, lambda n, i: F.when(n <= budget, i + 1).otherwise(0))
    return F.coalesce(F.array_max(within), F.lit(0))
