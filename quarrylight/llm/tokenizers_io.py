"""Loads the vocabularies of public tokenizers; a worker loads each once."""

from __future__ import annotations

import base64
import functools
import os
import re
from array import array
from collections.abc import Callable, Iterable
from itertools import islice

import numpy as np
import public_tokenizers

from .blocks import Coder, Ragged

BYTE_JSON, BYTE_RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: Strings that are one piece after a line feed, and hold none.
_PLAIN = re.compile(r" ?[^\s\x00-\x1f\x7f]+\Z")
#: A word of Latin letters, one match of the public pattern, and ASCII marks but apostrophes after it, which are another one.
_WORD = re.compile(r"( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-&(-/:-@\[-`{-~]*)\Z")
_OWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: The character that stands for each byte in byte-level vocabularies.
_BYTES = {b: b for b in _OWN} | {b: 256 + i for i, b in enumerate(sorted({*range(256)} - {*_OWN}))}


def vocabulary(name: str) -> str:
    return public_tokenizers.path(name)


@functools.cache
def json_tokenizer(path: str):
    """The tokenizer of a file, as the file has it."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.cache
def rank_encoding(path: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={})


@functools.cache
def token_bytes(path: str) -> Ragged:
    """The token-byte table: what each identifier decodes to."""
    table = [b""] * (max(ranks(path).values()) + 1)
    for piece, at in ranks(path).items():
        table[at] = piece
    return Ragged(np.frombuffer(b"".join(table), np.uint8), np.fromiter(map(len, table), np.int64, len(table)))


@functools.cache
def pretokens():
    import regex

    return regex.compile(public_tokenizers.PATTERN)


def _by_lines(lines: Callable[[str], Iterable[int]], single: Callable[[str], list[int]], feed: int, apart: str | None = None, size: int = 4000) -> Callable[[list[str]], Ragged]:
    """Identifiers of pieces. Plain ones are encoded together, one in a line, so that a call costs little for each.

    lines, single: identifiers of a text of many lines, and of one piece. feed: the identifier of a line feed.
    """

    def make(parts: list[str]) -> Ragged:
        plain = np.fromiter((bool(_PLAIN.match(p)) and not (apart and apart in p) for p in parts), bool, len(parts))
        own = [p for p, ok in zip(parts, plain.tolist(), strict=True) if ok]
        texts = ("\n".join([*own[i : i + size], ""]) for i in range(0, len(own), size))
        flat = np.concatenate([np.zeros(0, np.uint32), *(np.asarray(lines(x), np.uint32) for x in texts)])
        ends = np.flatnonzero(flat == feed)
        rest = Ragged.of([single(p) for p, ok in zip(parts, plain.tolist(), strict=True) if not ok], np.uint32)
        order = np.empty(len(parts), np.int64)
        order[np.flatnonzero(plain)] = np.arange(len(own))
        order[np.flatnonzero(~plain)] = np.arange(len(rest)) + len(own)
        return Ragged(np.concatenate([flat[flat != feed], rest.flat]), np.r_[np.diff(np.r_[-1, ends]) - 1, rest.lengths]).take(order)

    return make


def _by_words(tokenize: Callable[[str], list], rest: Callable[[list[str]], Ragged], apart: str | None = None) -> Callable[[list[str]], Ragged]:
    """Identifiers of pieces. Words, and marks that follow them, go to the merges without being matched again, each distinct one once; other pieces to ``rest``.

    tokenize: tokens of a match whose bytes are written as characters.
    """

    def make(parts: list[str]) -> Ragged:
        number: dict[str, int] = {"": 0}
        pairs: list[int] = []
        is_word, others = np.ones(len(parts), bool), []
        for i, p in enumerate(parts):
            if (m := _WORD.match(p)) and not (apart and apart in p):
                word, marks = m.groups()
                pairs += number.setdefault(word, len(number)), number.setdefault(marks, len(number))
            else:
                is_word[i] = False
                others.append(p)
        flat, lengths = array("I"), array("q", [0])
        for x in islice(number, 1, None):
            found = tokenize(x.replace(" ", "\u0120") if x.isascii() else x.encode().decode("latin-1").translate(_BYTES))
            flat.extend([t.id for t in found])
            lengths.append(len(found))
        words = Ragged(np.frombuffer(flat, np.uint32) if flat else np.zeros(0, np.uint32), np.array(lengths)).take(np.array(pairs, np.int64))
        other = rest(others)
        order = np.empty(len(parts), np.int64)
        order[is_word] = np.arange(len(pairs) // 2)
        order[~is_word] = np.arange(len(other)) + len(pairs) // 2
        return Ragged(np.concatenate([words.flat, other.flat]), np.r_[words.lengths.reshape(-1, 2).sum(axis=1), other.lengths]).take(order)

    return make


def json_coder(path: str) -> Coder:
    """Identifiers by the tokenizer of a file, which takes its added token out of texts first."""
    tokenizer = json_tokenizer(path)
    from tokenizers.models import BPE
    from tokenizers.pre_tokenizers import ByteLevel

    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    if len(added) > 1:
        raise ValueError("one added token at most")
    apart = added[0] if added else None

    def ids(text: str) -> list[int]:
        return tokenizer.encode(text, add_special_tokens=False).ids

    make, model, before = _by_lines(lambda text: tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, ids, ids("\n")[0], apart), tokenizer.model, tokenizer.pre_tokenizer
    if isinstance(before, ByteLevel) and before.use_regex and not before.add_prefix_space and tokenizer.normalizer is None and isinstance(model, BPE):
        make = _by_words(model.tokenize, make, apart)
    return Coder(make, apart.encode() if apart else None)


def rank_coder(path: str) -> Coder:
    """Identifiers by ranks, without added tokens."""
    encoding = rank_encoding(path)
    return Coder(_by_lines(encoding.encode_to_numpy, encoding.encode_ordinary, ranks(path)[b"\n"]))
