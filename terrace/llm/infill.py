"""Fill-in-the-middle: a text is cut into prefix, middle and suffix, whose order is changed so that the middle comes last.

A byte automaton reads each text once. Its table has a row for each state (how much of a sentinel has been read, or how many
continuation bytes of a character are due) and a column for each class of bytes; beside the next state a transition emits 1 if a
unit (a code point) begins there. Counts of those are the texts' lengths, states that complete a sentinel mark texts that stay
plain. A state follows from the last few bytes alone (as many as the longest sentinel has, four at least), so all positions of a
block step through the table together, each from as many bytes before it. A second pass finds the bytes where the cuts lie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of prefix, suffix and middle, in this order. ASCII.
SENTINELS = ("<P>", "<S>", "<M>")
#: Bytes that step through the table together.
BLOCK = 1 << 18

_FIELDS = {"n": ("bigint", pa.int64()), "form": ("string", pa.string()), "prefix_chars": ("bigint", pa.int64()), "middle_chars": ("bigint", pa.int64()), "output": ("string", pa.string())}


class Automaton:
    """Tables over bytes: `step` and `emits` by state and class, `hits` by state (a sentinel is complete)."""

    def __init__(self, sentinels: tuple[str, ...]) -> None:
        if not all(s and s.isascii() for s in sentinels):
            raise ValueError("sentinels are ASCII and not empty")
        starts = sorted({s[:k] for s in sentinels for k in range(len(s) + 1)}, key=lambda s: (len(s), s))  # the empty one is state 0
        own = sorted({*"".join(sentinels).encode()})
        other, more, lead = len(own), len(own) + 1, len(own) + 2  # other ASCII, continuation bytes, leading bytes of 2, 3 and 4
        self.class_of = np.full(256, other, np.uint8)
        self.class_of[own] = range(len(own))
        self.class_of[0x80:0xC0], self.class_of[0xC0:0xE0], self.class_of[0xE0:0xF0], self.class_of[0xF0:] = more, lead, lead + 1, lead + 2
        self.width, due = lead + 3, len(starts)  # state due + k - 1: k continuation bytes are due
        step, emits = np.zeros((due + 3, self.width), np.int16), np.ones((due + 3, self.width), np.uint8)
        for state in range(due + 3):
            for k, byte in enumerate(own):
                read = (starts[state] if state < due else "") + chr(byte)
                step[state, k] = next(starts.index(read[i:]) for i in range(len(read) + 1) if read[i:] in starts)
            step[state, lead:] = due + np.arange(3)
            if state >= due:
                step[state, more], emits[state, more] = (state - 1 if state > due else 0), 0
        self.step, self.emits = step.ravel(), emits.ravel()
        self.hits = np.array([s < due and any(starts[s].endswith(x) for x in sentinels) for s in range(due + 3)])
        self.reach = max(4, *map(len, sentinels))

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """data: bytes of texts, one after the other; offsets: where they begin, and the end. For each byte whether a unit begins there, and the places of bytes that complete a sentinel."""
        units, hits = np.empty(len(data), np.uint8), [np.empty(0, np.int64)]
        begins = offsets[:-1][np.diff(offsets) > 0]
        for a in range(0, len(data), BLOCK):
            b, back = min(a + BLOCK, len(data)), max(0, a - self.reach)
            classes = self.class_of[data[back:b]]
            fresh = begins[np.searchsorted(begins, back) : np.searchsorted(begins, b)] - back
            state = np.zeros(len(classes), np.int16)
            for t in reversed(range(self.reach)):  # each position reads the byte t before it
                state[t:] = self.step[state[t:] * self.width + classes[: len(classes) - t]]
                early = (fresh[:, None] + np.arange(t)).ravel()  # that byte is before the text
                # A text shorter than t lends its places to the next, whose own first ones are among them.
                state[early[early < len(state)]] = 0
            before = np.concatenate([[0], state[:-1]]).astype(np.int16)
            before[fresh] = 0
            units[a:b] = self.emits[before * self.width + classes][a - back :]
            hits.append(np.flatnonzero(self.hits[state[a - back :]]) + a)
        return units, np.concatenate(hits)


def find_units(units: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The places of the units with these ranks (from 0, ascending order not needed); len(units) for a rank beyond the last."""
    out, before = np.full(len(ranks), len(units), np.int64), 0
    order = np.argsort(ranks, kind="stable")
    ranked = ranks[order]
    for a in range(0, len(units), BLOCK):
        places = np.flatnonzero(units[a : a + BLOCK])
        lo, hi = np.searchsorted(ranked, [before, before + len(places)])
        out[order[lo:hi]] = places[ranked[lo:hi] - before] + a
        before += len(places)
    return out


def _rearranged(automaton: Automaton, marks: list[bytes], texts: pa.Array, keys: list[np.ndarray], plain: int, spm: int) -> pa.StructArray:
    if texts.null_count:
        texts = texts.fill_null("")
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    units, hits = automaton.scan(data, offsets)
    size = np.diff(offsets)
    many = np.zeros(len(size), np.int64)
    if size.any():
        many[size > 0] = np.add.reduceat(units, offsets[:-1][size > 0], dtype=np.int64)
    stays = (size == 0) | (keys[2] % 100 >= 100 - plain)
    stays[np.searchsorted(offsets, hits, "right") - 1] = True
    cuts = np.sort([keys[0] % (many + 1), keys[1] % (many + 1)], axis=0)
    first = np.cumsum(many) - many
    at = [np.where(cut == many, offsets[1:], find_units(units, first + cut)) for cut in cuts]
    whole = data.tobytes()
    output, form = [], []
    for a, x, y, b, same, last in zip(offsets[:-1].tolist(), at[0].tolist(), at[1].tolist(), offsets[1:].tolist(), stays.tolist(), (keys[3] % 100 < spm).tolist(), strict=True):
        form.append("plain" if same else "spm" if last else "psm")
        if same:
            output.append(whole[a:b])
        elif last:
            output.append(b"".join((marks[1], whole[y:b], marks[0], whole[a:x], marks[2], whole[x:y])))
        else:
            output.append(b"".join((marks[0], whole[a:x], marks[1], whole[y:b], marks[2], whole[x:y])))
    chars = [pa.array(c, pa.int64(), mask=stays) for c in (cuts[0], cuts[1] - cuts[0])]
    return pa.StructArray.from_arrays([pa.array(many), pa.array(form, pa.string()), *chars, pa.array(output, pa.binary()).view(pa.string())], names=list(_FIELDS))


def fill_in_middle(
    docs: DataFrame, *, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, sentinels: tuple[str, str, str] = SENTINELS,
    id_col: str = "doc_id", text_col: str = "text", out_col: str = "fim",
) -> DataFrame:
    """docs with a struct: n (code points), form (plain, psm, spm), prefix_chars and middle_chars (null if plain), output.

    Where a text is cut and its form follow from a hash of seed and id, so repeated rows come out alike. A null text counts as
    empty, a null id as an empty one; an empty text, or one that holds a sentinel, stays plain. Texts may be of any length; an
    empty table gives an empty one; other columns stay, whatever their names (one named out_col is replaced).
    """
    automaton, marks = Automaton(sentinels), [s.encode() for s in sentinels]

    @F.arrow_udf(f"struct<{', '.join(f'{k}: {v[0]}' for k, v in _FIELDS.items())}>")
    def rearranged(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, *keys in batches:
            yield _rearranged(automaton, marks, texts, [k.to_numpy(zero_copy_only=False) for k in keys], plain_percent, spm_percent)

    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    keys = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    return docs.withColumn(out_col, rearranged(F.col(text_col).cast("string"), *keys))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output of this form was made of; null stays null."""
    import re

    part = F.split(output, "|".join(re.sub(r"([^A-Za-z0-9])", r"\\\1", s) for s in sentinels), -1)
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)
