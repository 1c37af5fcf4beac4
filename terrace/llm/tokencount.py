"""Token counts of texts by byte-level byte-pair merging, without the tokens.

A text is split at special tokens, the parts into words by the pattern of the vocabulary. A word's bytes are a linked list, its
adjacent pairs that can merge a heap by rank and place. The lowest pair is popped, merged if it still stands, and its new
neighbours are pushed; each merge makes the list one shorter, so a word has as many tokens as bytes, less the merges. Counts of
words are remembered up to a bound. Which characters the pattern takes for letters and numbers is asked of the tokenizer once,
since libraries know different versions of Unicode.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.packing import BYTE_NAMES

#: Words that a worker remembers (and as many from before them), their greatest length, and the characters of a text beyond which words aren't listed at once.
CACHE_WORDS, CACHE_LENGTH, LISTED = 300_000, 64, 1 << 20

# Fixed value: the pattern of the vocabulary; {0} is where letters and numbers stand that the tokenizer doesn't know.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?{other}+|\s+(?!\S)|\s+"


def _ranges(codes: list[int]) -> str:
    """Ascending code points as the inside of a set of a pattern."""
    ends = [k for k in range(len(codes)) if k + 1 == len(codes) or codes[k + 1] != codes[k] + 1]
    return "".join(f"\\U{codes[a]:08x}-\\U{codes[b]:08x}" for a, b in zip([0, *(k + 1 for k in ends)], ends))


class TokenCounter(dict):
    """Counts by word; a word that isn't there is merged and, if short, remembered."""

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        self.old: dict[str, int] = {}
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, split = told["model"], told["pre_tokenizer"]
        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback")) and told["normalizer"] is None
        if not plain or split.get("type") != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"]:
            raise ValueError(f"{path} isn't a plain byte-level vocabulary")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in told["added_tokens"]):
            raise ValueError(f"{path} has special tokens that take blanks or look around")
        byte = {c: b for b, c in BYTE_NAMES.items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {tuple(bytes(byte[c] for c in half) for half in pair): k for k, pair in enumerate(pairs)}
        special = sorted((t["content"] for t in told["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.words = regex.compile(WORDS.format(letter=r"\p{L}", number=r"\p{N}", other=r"[^\s\p{L}\p{N}]"))
        # Characters that are letters or numbers here but not to the tokenizer run together with the "!" before and after.
        known = regex.findall(r"[\p{L}\p{N}]", "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000)))))
        begins = {a for _, (a, _) in Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str("".join("!" + c for c in known))}
        new = _ranges([ord(c) for k, c in enumerate(known) if 2 * k + 1 not in begins])
        self.unknown = regex.compile(f"[{new}]") if new else None
        if new:
            self.exact = regex.compile("(?V1)" + WORDS.format(letter=rf"[\p{{L}}--[{new}]]", number=rf"[\p{{N}}--[{new}]]", other=rf"(?:[^\s\p{{L}}\p{{N}}]|[{new}])"))

    def __missing__(self, word: str) -> int:
        many = self.old.get(word) or self.merged(word.encode())
        if len(word) <= CACHE_LENGTH:
            if len(self) >= CACHE_WORDS:
                self.old = dict(self)
                self.clear()
            self[word] = many
        return many

    def merged(self, word: bytes) -> int:
        """How many tokens the bytes of one word are."""
        n, ranks = len(word), self.ranks
        part: list[bytes | None] = [word[k : k + 1] for k in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n))
        heap = [(ranks[pair], k, pair[0] + pair[1]) for k, pair in enumerate(zip(part, part[1:])) if pair in ranks]
        heapify(heap)
        merges = 0
        while heap:
            _, k, made = heappop(heap)
            right = after[k]
            if part[k] is None or right == n or (part[k], part[right]) not in ranks or part[k] + part[right] != made:
                continue  # one of the two has merged with another since
            part[k], part[right] = made, None
            after[k] = after[right]
            before[after[k]] = k
            merges += 1
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b < n and (pair := (part[a], part[b])) in ranks:
                    heappush(heap, (ranks[pair], a, pair[0] + pair[1]))
        return n - merges

    def count(self, text: str) -> int:
        """Tokens of a whole text, special tokens one each."""
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))

    def _plain(self, text: str) -> int:
        words = self.words if text.isascii() or self.unknown is None or not self.unknown.search(text) else self.exact
        if len(text) > LISTED:
            return sum(self[m[0]] for m in words.finditer(text))
        return sum(map(self.__getitem__, words.findall(text)))


@lru_cache(maxsize=1)
def counter_of(path: str) -> TokenCounter:
    """The worker's counter: tasks after the first find its words."""
    return TokenCounter(path)


def count_tokens(docs: DataFrame, tokenizer_path: str, *, limit: int = 1024, text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with n_bytes (of UTF-8), n_tokens and over_limit, their names after prefix. tokenizer_path: a byte-level vocabulary, on every executor.

    A null text counts as empty: 0 bytes, 0 tokens. Texts of any length are counted whole, repeated rows alike; an empty table
    gives an empty one; other columns stay, whatever their names (those of the result's names are replaced).
    """
    @F.arrow_udf("bigint")
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = counter_of(tokenizer_path)
        for texts in batches:
            yield pa.array([counter.count(text.as_py() or "") for text in texts], pa.int64())

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    made = docs.withColumns({f"{prefix}n_bytes": F.octet_length(text).cast("long"), f"{prefix}n_tokens": tokens(text)})
    return made.withColumn(f"{prefix}over_limit", F.col(f"{prefix}n_tokens") > limit)
