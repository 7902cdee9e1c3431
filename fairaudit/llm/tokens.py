"""Exact token ids at the cost of a dictionary lookup per word.

The vocabulary drops white space and never merges across it, so a text's ids
are the ids of its white-space-free chunks, one after another. Every distinct
chunk is given to ``tokenizers`` once and its ids kept as bytes in a bounded
cache of the Python worker; clearing the cache changes no result.
"""

from __future__ import annotations

import itertools
import os
import re
import unicodedata

from .worker import keep_for

CACHE_MAX = 800_000          # chunks kept by a worker
LONG_CHUNK = 64              # longer chunks are encoded but not kept
SLICE_CHARS = 1_000_000      # characters of text handled together

_STATE: dict = {"name": None, "tok": None, "cache": {}}
_ASCII_WS = re.compile(r"[ \t\n\r]+")
# letters with punctuation before and after; an apostrophe before letters may be a contraction
_AFFIXED = re.compile(r"([^\w\s']*)([^\W\d_]+)([^\w\s]*)$")
_SEPARATORS = re.compile("[\x1c-\x1f]")


def _forget() -> None:
    """Drop the worker's tokenizer and its ids of chunks."""
    for k in ("ends", "plain"):
        _STATE.pop(k, None)
    _STATE.update(name=None, tok=None, cache={})


def tokenizer(path: str):
    """The worker's tokenizer for a vocabulary file."""
    if _STATE["name"] != path:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        _STATE.pop("ends", None)
        _STATE.update(name=path, tok=Tokenizer.from_file(path), cache={})
    return _STATE["tok"]


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _pack(ids: list[int]) -> bytes:
    import numpy as np
    return np.asarray(ids, dtype="<u4").tobytes()


def _chunks(text: str) -> list[str] | None:
    """White-space-free chunks whose ids concatenate to the text's ids.

    None if the text may hold a special token, which is found in whole texts.
    The vocabulary composes characters first (NFC), which joins a letter with the
    mark behind it, so texts are composed before they are cut.
    Latin-1 letters are lower-cased here already (the vocabulary does so), to
    have fewer distinct chunks; other texts are left as they are.
    """
    if "<|" in text:
        return None
    if not text.isascii() and not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    try:
        text.encode("latin-1")
        text = text.lower()
    except UnicodeEncodeError:
        pass
    if _SEPARATORS.search(text):
        return [c for c in _ASCII_WS.split(text) if c]
    return text.split()


def encode_texts(texts: list[str | None], path: str) -> list[bytes]:
    """Little-endian unsigned 32-bit ids of each text (null: none)."""
    keep_for("chunks", _forget)
    tok = tokenizer(path)
    out: list[bytes] = []
    at = 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and (end == at or chars + len(texts[end] or "") <= SLICE_CHARS):
            chars += len(texts[end] or "")
            end += 1
        out.extend(_encode_slice(texts[at:end], tok))
        at = end
    return out


def _encode_parts(parts: list[str], tok) -> dict[str, bytes]:
    """Ids of distinct chunks. Words of letters alone are one pre-token each, so
    many go to the tokenizer as one text and are cut after each word end."""
    import numpy as np
    if "ends" not in _STATE:
        ends = np.zeros(tok.get_vocab_size(), dtype=bool)
        for token, i in tok.get_vocab().items():
            ends[i] = token.endswith("</w>")
        _STATE["ends"] = ends
        from tokenizers import Tokenizer, pre_tokenizers
        # lower-case Latin-1 words need neither the normaliser nor the split pattern
        plain = Tokenizer.from_str(tok.to_str())
        plain.normalizer = None
        plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        _STATE["plain"] = plain
    words = [p for p in parts if p.isalpha() and p == p.lower() and max(p) < "\u0100"]
    known = set(words)
    rest = [p for p in parts if p not in known]
    out: dict[str, bytes] = {}
    groups = [words[i:i + 500] for i in range(0, len(words), 500)]
    for group, e in zip(groups, _STATE["plain"].encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
        ids = np.asarray(e.ids, dtype="<u4")
        cuts = np.flatnonzero(_STATE["ends"][ids]) + 1
        if len(cuts) != len(group):
            rest.extend(group)
            continue
        data, at = ids.tobytes(), 0
        for w, c in zip(group, cuts.tolist()):
            out[w] = data[4 * at:4 * c]
            at = c
    for p, e in zip(rest, tok.encode_batch_fast(rest, add_special_tokens=False)):
        out[p] = _pack(e.ids)
    return out


def _encode_slice(texts: list[str | None], tok) -> list[bytes]:
    cache = _STATE["cache"]
    if len(cache) > CACHE_MAX:
        cache.clear()
    lists = [_chunks(t) if t else [] for t in texts]
    missing: set[str] = set()
    for chunks in lists:
        if chunks:
            missing.update(itertools.filterfalse(cache.__contains__, chunks))
    local: dict[str, bytes] = {}
    if missing:
        # "(word)," is "(", "word" and "),": only the parts need the tokenizer
        bases: set[str] = set()
        split: dict[str, tuple[str, ...]] = {}
        for c in missing:
            # lower case turns U+0130 into a letter and a mark, which goes with what follows
            m = None if c.isalpha() or "\u0130" in c else _AFFIXED.match(c)
            if m:
                split[c] = parts = tuple(filter(None, m.groups()))
                bases.update(parts)
            else:
                bases.add(c)
        new = _encode_parts([b for b in bases if b not in cache], tok)
        for b, ids in new.items():
            (cache if len(b) <= LONG_CHUNK else local)[b] = ids
        for c, parts in split.items():
            whole = b"".join([cache[b] if b in cache else local[b] for b in parts])
            (cache if len(c) <= LONG_CHUNK else local)[c] = whole
    out = []
    for t, chunks in zip(texts, lists):
        if chunks is None:
            out.append(_pack(tok.encode(t, add_special_tokens=False).ids))
        elif local:
            out.append(b"".join([local[c] if c in local else cache[c] for c in chunks]))
        else:
            out.append(b"".join(map(cache.__getitem__, chunks)))
    return out
