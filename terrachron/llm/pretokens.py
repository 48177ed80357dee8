"""Splits text into the pre-tokens of a public tokenizer file, quickly where that is safe.

Texts whose characters all belong to ``SAFE`` are split here by a regular expression over explicit classes; any
other text, and any with a special string, goes through the library, so both ways give the library's pre-tokens.
"""

from __future__ import annotations

import re
from functools import lru_cache

#: Letters, numbers and white space below U+02B0, and further punctuation and currency signs that are none of these.
LETTERS, NUMBERS, SPACES = "A-Za-zªµºÀ-ÖØ-öø-ʯ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
SAFE = "\x00-ʯ‐-‧‰-⁞₠-⃀™"
UNSAFE = re.compile(f"[^{SAFE}]")
BYTE_PATTERN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
WORD_PATTERN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+")


@lru_cache(maxsize=4)
def load(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@lru_cache(maxsize=4)
def model(path: str):
    return load(path).model


@lru_cache(maxsize=4)
def specials(path: str) -> re.Pattern | None:
    names = sorted((x.content for x in load(path).get_added_tokens_decoder().values()), key=len, reverse=True)
    return re.compile("|".join(map(re.escape, names))) if names else None


def byte_level(path: str, text: str) -> tuple[list[str], int]:
    """The pre-tokens of ``text`` under a byte-level tokenizer, and how many special strings stand between them."""
    special = specials(path)
    parts = special.split(text) if special else [text]
    out: list[str] = []
    for part in parts:
        if not part.isascii() and UNSAFE.search(part):
            out += [part[a:b] for _, (a, b) in load(path).pre_tokenizer.pre_tokenize_str(part)]
        else:
            out += BYTE_PATTERN.findall(part)
    return out, len(parts) - 1


def byte_alphabet() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


ALPHABET = byte_alphabet()


def ids_of(path: str, pretoken: str) -> list[int]:
    """The ids of one pre-token."""
    return [t.id for t in model(path).tokenize(pretoken.encode().decode("latin-1").translate(ALPHABET))]


def word_level(path: str, text: str) -> list[str | int]:
    """The lower-cased pre-tokens of ``text`` under a word-level tokenizer; special strings come as their ids."""
    special = specials(path)
    out: list[str | int] = []
    at = 0
    for found in [*(special.finditer(text) if special else ()), None]:
        part = text[at : found.start()] if found else text[at:]
        lower = part.lower()
        if not part.isascii() and (UNSAFE.search(part) or UNSAFE.search(lower)):
            tokenizer = load(path)
            normal = tokenizer.normalizer.normalize_str(part)
            out += [normal[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(normal)]
        else:
            out += WORD_PATTERN.findall(lower)
        if found:
            out.append(load(path).token_to_id(found[0]))
            at = found.end()
    return out
