"""Encoding by distinct pre-tokens, shared by token counts and token output.

A byte-level BPE never merges across pre-tokens, so a text's ids are the ids of
its pre-tokens in a row.  Pre-tokens are cut by the standard library's regular
expressions where a text has only characters on whose classes all libraries
agree (ASCII without the separators 1C-1F, Latin letters up to U+024F, common
punctuation) and no special string.  For counts, any other text is parted at special
strings and cut by the library's own pre-tokenizer; for ids it is encoded whole.  All
ways give the tokenizers library's own result.  Files of other kinds (sentencepiece,
other pre-tokenizers or normalizers) know no pre-tokens: there a whole text is one.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from functools import cache

#: Fixed value: the byte-level pattern of public GPT-2 style vocabularies (letters,
#: digits, others, white space), for texts without unsure characters.
LETTERS, SPACES = "A-Za-zªµºÀ-ÖØ-öø-ɏ", r"\t-\r "
PRETOKEN = re.compile(
    rf"'(?:[sdmt]|ll|ve|re)| ?[{LETTERS}]+| ?[0-9]+| ?[^{SPACES}{LETTERS}0-9]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
)
#: Characters that send a text to the library as a whole.
UNSURE = r"[^\x00-\x1b\x20-\x7f\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ‐-‧‰-‾€]"
#: A cache of pre-tokens is emptied at this size.
MOST = 1_000_000


class Pieces(dict):
    """What is kept of every pre-token's ids; a new one is encoded when it is first asked for."""

    def __init__(self, encode: Callable[[str], object]):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> object:
        value = self[word] = self.encode(word)
        return value


class Encoder:
    """piece: what is kept of a pre-token's ids (their number, their bytes, ...); plain: special strings in texts are plain text."""

    def __init__(self, path: str, piece: Callable[[list[int]], object], plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.cut, self.known = None, Pieces(piece)
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.whole = lambda texts: model.encode(texts, num_threads=1)
            self.vocabulary = lambda: {model.id_to_piece(i): i for i in range(model.get_piece_size())}
            return
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        tokenizer.encode_special_tokens = plain
        self.vocabulary = tokenizer.get_vocab
        self.whole = lambda texts: [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        pre, model = said.get("pre_tokenizer") or {}, said["model"]
        byte_level = (
            pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
            and said.get("normalizer") is None and model.get("type") == "BPE" and not model.get("dropout")
        )
        added = () if plain else said.get("added_tokens") or ()
        if byte_level and not any(x.get(k) for x in added for k in ("single_word", "lstrip", "rstrip")):
            special = [re.escape(x["content"]) for x in sorted(added, key=lambda x: -len(x["content"]))]
            self.cut = re.compile("|".join([*special, UNSURE]))
            self.special = re.compile("|".join(special) or r"(?!)")
            self.library = tokenizer.pre_tokenizer.pre_tokenize_str
            letters, tokenize = byte_letters(), tokenizer.model.tokenize
            self.known = Pieces(lambda word: piece([x.id for x in tokenize(word.encode().decode("latin-1").translate(letters))]))

    def pretokens(self, text: str) -> list[str] | None:
        """None: the text must be encoded whole."""
        if self.cut is None or self.cut.search(text):
            return None
        return PRETOKEN.findall(text)

    def parted(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of any text, and the number of special strings (one id each)."""
        if self.cut is None:
            return ([text] if text else []), 0
        if not self.cut.search(text):
            return PRETOKEN.findall(text), 0
        parts = self.special.split(text)
        return [part[a:b] for part in parts for _, (a, b) in self.library(part)], len(parts) - 1

    def count(self, pretoken: str) -> int:
        """The number of a pre-token's ids."""
        return len(self.whole([pretoken])[0]) if self.cut is None else self.known[pretoken]

    def pieces(self) -> Pieces:
        """The pieces of pre-tokens, emptied when there are too many."""
        if len(self.known) > MOST:
            self.known.clear()
        return self.known


@cache
def byte_letters() -> dict[int, int]:
    """How byte-level vocabularies write bytes: visible Latin-1 characters stand for
    themselves, the other bytes, in order, for characters from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: 256 + k for k, b in enumerate(hidden)}


@cache
def encoder(path: str, kind: str, plain: bool = False) -> Encoder:
    """One for each worker process; kind: counts, ids (as little-endian bytes) or lists (of ids)."""
    import array

    piece = {"counts": len, "ids": lambda ids: array.array("I", ids).tobytes(), "lists": list}[kind]
    return Encoder(path, piece, plain)
