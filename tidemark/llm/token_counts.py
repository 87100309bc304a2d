"""Token counts by the whole-token shortcut.

Most pre-tokens of ordinary text are vocabulary strings which the tokenizer
encodes as one token.  ``prove_whole_tokens`` establishes that set once, by
asking the tokenizer itself; texts are then counted by dictionary lookup, and
only pieces outside the set go through the merges.

Inputs and edge cases: null and empty texts have 0 tokens; the text of a
special token inside a document counts as that token (the library's default);
rows are independent, so repeated rows and null ids pass through unchanged;
an empty table gives an empty result.  Extra columns are kept, and columns named
as a result are replaced.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tidemark.llm.common import field, packed, ship_package, unpacked, whole_text

#: Entries a worker's memo may hold before it is started afresh.
MEMO_ENTRIES = 250_000
#: Texts that are looked up together.
BLOCK_TEXTS = 256
#: New pieces that are encoded together.
ENCODE_PIECES = 2_000
#: Longest piece that is remembered.
MEMO_PIECE = 64

#: White space other than the space and the line feed.
_ODD_SPACE = re.compile(r"[^\S \n]")
#: Text in which Python's and the tokenizer's letter classes agree.
LATIN = _LATIN = re.compile("[\x00-ɏ]*\\Z")
#: Fixed value: how a byte-level tokenizer cuts a text.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PRE_TOKEN = regex.compile(PRE_TOKENS)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in shown}
    hidden = (b for b in range(256) if b not in set(shown))
    return table | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def prove_whole_tokens(tokenizer) -> frozenset[str]:
    """Vocabulary strings that the tokenizer encodes, alone, as one token.

    A string is accepted only if it is also a single pre-token, so that finding
    it as a pre-token of a longer text gives the same single token.
    """
    alphabet = byte_alphabet()
    texts = []
    for token in tokenizer.get_vocab(with_added_tokens=False):
        try:
            text = bytes(alphabet[c] for c in token).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue
        if _LATIN.match(text) and _PRE_TOKEN.fullmatch(text) and _PRE_TOKEN.findall(text) == [text]:
            texts.append(text)
    encoded = tokenizer.encode_batch(texts, add_special_tokens=False)
    return frozenset(t for t, e in zip(texts, encoded, strict=True) if len(e.ids) == 1)


class TokenCounter:
    """Counts the tokens of texts as ``tokenizer.encode`` would give them.

    ``bare`` remembers pieces as they stand, ``spaced`` pieces after one space.
    """

    def __init__(self, tokenizer, whole: frozenset[str]):
        self.tokenizer, self.whole = tokenizer, whole
        special = sorted((t.content for t in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.cut = re.compile("|".join(map(re.escape, special))) if special else None
        self.forget()

    def forget(self) -> None:
        self.bare = dict.fromkeys(self.whole, 1)
        self.spaced = {t[1:]: 1 for t in self.whole if t[0] == " " and len(t) > 1}

    def learn(self, pieces: set[str]) -> dict[str, int]:
        """Token counts of new pieces: whole pre-tokens directly, the rest by merging."""
        parts = {p: _PRE_TOKEN.findall(p) if _LATIN.match(p) else [p] for p in pieces}
        known = self.bare
        rest = list({t for ts in parts.values() for t in ts if t not in known})
        counts = {}
        for start in range(0, len(rest), ENCODE_PIECES):
            some = rest[start : start + ENCODE_PIECES]
            counts.update((t, len(e.ids)) for t, e in zip(some, self.tokenizer.encode_batch(some, add_special_tokens=False), strict=True))
        return {p: sum(counts[t] if t in counts else known[t] for t in ts) for p, ts in parts.items()}

    def pieces(self, text: str) -> tuple[list[str], list[str]]:
        """Pieces as they stand, and pieces after one space.

        Where every white space is a single space or line feed between other
        characters, pre-tokens begin at each; else the text is cut by pre-token.
        """
        if _ODD_SPACE.search(text) or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n":
            return (_PRE_TOKEN.findall(text) if _LATIN.match(text) else [text]), []
        bare, spaced = [], []
        for line in text.split("\n"):
            first, *others = line.split(" ")
            bare.append(first)
            spaced += others
        bare += ["\n"] * (len(bare) - 1)
        return bare, spaced

    def count(self, texts: list[str]) -> list[int]:
        totals: list[int] = []
        for start in range(0, len(texts), BLOCK_TEXTS):
            if len(self.bare) + len(self.spaced) > MEMO_ENTRIES:
                self.forget()
            totals += self.count_block(texts[start : start + BLOCK_TEXTS])
        return totals

    def count_block(self, texts: list[str]) -> list[int]:
        """One lookup pass over a few texts, with one call to the library for what is new."""
        totals, open_bare, open_spaced = [], [], []
        for i, text in enumerate(texts):
            sections = self.cut.split(text) if self.cut else [text]
            total = len(sections) - 1
            for section in filter(None, sections):
                for pieces, memo, missing in zip(self.pieces(section), (self.bare, self.spaced), (open_bare, open_spaced), strict=True):
                    counts = list(map(memo.get, pieces))
                    if None in counts:
                        missing += [(i, p) for p, n in zip(pieces, counts, strict=True) if n is None]
                        counts = filter(None, counts)
                    total += sum(counts)
            totals.append(total)
        for lead, memo, missing in (("", self.bare, open_bare), (" ", self.spaced, open_spaced)):
            learnt = self.learn({lead + p for _, p in missing})
            for i, p in missing:
                totals[i] += learnt[lead + p]
            memo.update((p, n) for _, p in missing if len(p) <= MEMO_PIECE and (n := learnt[lead + p]))
        return totals


#: One counter for each tokenizer and worker, so that its memo outlives a task.
_COUNTERS: dict[str, TokenCounter] = {}


def token_count_udf(load: TokenizerFile, whole: frozenset[str]) -> Callable[[Column], Column]:
    """A column function; ``load`` opens the tokenizer inside each worker."""

    @F.pandas_udf(LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if load.name not in _COUNTERS:
            _COUNTERS[load.name] = TokenCounter(load(), whole)
        counter = _COUNTERS[load.name]
        for texts in batches:
            yield pd.Series(counter.count(texts.tolist()), dtype="int64")

    return count


class TokenizerFile:
    """Opens a public tokenizer by name, where it runs."""

    def __init__(self, name: str):
        self.name = name

    def __call__(self):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one worker a core already
        import public_tokenizers
        from tokenizers import Tokenizer

        return Tokenizer.from_file(public_tokenizers.path(self.name))


def count_tokens(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 1024, text: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit``.

    The proven set is bounded by the vocabulary (50,257 strings here), whatever
    the corpus; it travels with the function.
    """
    ship_package(docs.sparkSession)
    load = TokenizerFile(tokenizer)
    whole = prove_whole_tokens(load())
    n_tokens = token_count_udf(load, whole)(whole_text(field(text)))
    counted = packed(docs).withColumn("n", n_tokens)
    return unpacked(counted, n_bytes=F.octet_length(whole_text(field(text))).cast("long"), n_tokens=F.col("n"), over_limit=F.col("n") > F.lit(limit))
