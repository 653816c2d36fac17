"""Tokenising whole texts with a public vocabulary, one distinct word at a time.

The word-level vocabulary never joins characters across ASCII white space, so the ids of a text are the ids of
its white-space separated words, in order. Words repeat far more often than they are new: each worker keeps a
bounded table of words it has already encoded and runs the library only on new ones.
"""

from __future__ import annotations

import re
import struct

import numpy as np

from vectorloom.llm import memo

#: Words kept per worker process; the table is emptied when full. Longer words are encoded but not kept.
MAX_WORDS = 250_000
MAX_KEPT_BYTES = 48
CHUNK_WORDS = 4_000

_tokenizers: dict[str, object] = {}


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer(path: str):
    if path not in _tokenizers:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stays, the rest follow 255."""
    stay = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in stay]
    return {**{b: chr(b) for b in stay}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


_LETTERS = _byte_letters()
#: A run of Latin letters, then one run of marks: two pre-tokens at most, whose ids are found apart.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,!?;:&%$#*|]*)")


def _whole(path: str, words: list[str]) -> list[bytes]:
    """Ids of words of any kind: the library's full path, one call for many words."""
    tok = tokenizer(path)
    out: list[bytes] = []
    for at in range(0, len(words), CHUNK_WORDS):
        part = words[at : at + CHUNK_WORDS]
        code = tok.encode(" ".join(part), add_special_tokens=False)
        raw = np.asarray(code.ids, dtype="<u4").tobytes()
        ends = np.cumsum([len(w) + 1 for w in part])
        first = np.fromiter((o[0] for o in code.offsets), np.int64, len(code.ids))
        low = 0
        for high in np.searchsorted(first, ends, side="left").tolist():
            out.append(raw[4 * low : 4 * high])
            low = high
    return out


def _encode_new(path: str, words: list[bytes], known: dict[bytes, bytes]) -> dict[bytes, bytes]:
    """Ids (little-endian uint32) of each new word.

    A word of Latin letters is one pre-token, so the library's model alone gives its ids; marks after it are
    another. All other words take the library's full path.
    """
    model = tokenizer(path).model.tokenize
    got: dict[bytes, bytes] = {}
    other: list[bytes] = []
    for w in words:
        text = w.decode("utf-8")
        m = _PLAIN.fullmatch(text)
        if not m:
            other.append(w)
            continue
        core, tail = m[1].lower(), m[2].encode()
        key = core.encode()
        ids = got.get(key) or known.get(key)
        if ids is None:
            spelt = core if core.isascii() else key.decode("latin-1").translate(_LETTERS)
            found = [t.id for t in model(spelt)]
            ids = struct.pack(f"<{len(found)}I", *found)
            got[key] = ids
        if tail:
            marks = got.get(tail) or known.get(tail)
            if marks is None:
                marks = got[tail] = _whole(path, [m[2]])[0]
            ids += marks
        got[w] = ids
    if other:
        got.update(zip(other, _whole(path, [w.decode("utf-8") for w in other]), strict=True))
    return got


def encode_texts(path: str, texts: list[bytes | None]) -> list[bytes]:
    """Ids of each text (UTF-8 bytes; null is empty) as little-endian uint32."""
    known: dict[bytes, bytes] = memo.table(f"tokens {path}")
    out = []
    for text in texts:
        if not text:
            out.append(b"")
            continue
        words = text.split()
        new = [w for w in set(words) if w not in known]
        if not new:
            out.append(b"".join(map(known.__getitem__, words)))
            continue
        if len(known) + len(new) > MAX_WORDS:
            known.clear()
            new = list(set(words))
        got = _encode_new(path, new, known)
        kept = {w: ids for w, ids in got.items() if len(w) <= MAX_KEPT_BYTES}
        if len(kept) == len(got) and len(kept) <= MAX_WORDS:
            known.update(kept)
            out.append(b"".join(map(known.__getitem__, words)))
        else:
            if len(known) + len(kept) <= MAX_WORDS:
                known.update(kept)
            out.append(b"".join([got[w] if w in got else known[w] for w in words]))
    return out


def encode_column(path: str, column) -> list[bytes]:
    """As ``encode_texts`` for an Arrow string column."""
    import pyarrow as pa

    return encode_texts(path, column.cast(pa.large_binary()).to_pylist())
