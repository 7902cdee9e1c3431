"""Exact ids of a byte-level vocabulary at the cost of a lookup per word.

The vocabulary's pre-tokens never reach from a character that is no white space
into white space. A text can therefore be cut before every space that has none
on its left or none on its right, and the ids of the parts are the ids of the
text. Arrow cuts the texts and numbers their distinct parts, so that Python handles each
once in a slice. Ids of distinct parts are kept as bytes in a bounded cache of the Python
worker; clearing it changes no result. New parts of letters and ASCII punctuation
are cut once more where the vocabulary's pattern does, and their words go to
``tokenizers`` many at a time as one text, whose ids are cut by the bytes that
each id stands for.
"""

from __future__ import annotations

import os
import re
import string
from collections.abc import Iterator

import numpy as np

from .columns import spans

CACHE_MAX = 800_000          # parts kept by a worker
LONG_PART = 64               # longer parts are encoded but not kept
JOINED = 500                 # parts given to the tokenizer as one text
SLICE_BYTES = 8_000_000      # of text handled together

_STATE: dict = {"name": None}
# " word," or " word.\nWord,": each group is a pre-token, the first with the space before it
_FORM = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]*)(?:(\n)([^\W\d_]+)([!-&(-/:-@\[-`{-~]*))?\Z")
# white space of the vocabulary's own pattern (Unicode), and what follows it
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# a space between white space: cutting there could break a run of white space
_INSIDE = f"[{_WHITE}\x1c-\x1f] (?:[{_WHITE}\x1c-\x1f]|$)"
# ASCII punctuation behind a word is a pre-token of its own; an apostrophe may begin a contraction
_TAIL = "".join(c for c in string.punctuation if c != "'")
_RUNS = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")


def _load(path: str) -> dict:
    if _STATE["name"] != path:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(path)
        size = np.zeros(tok.get_vocab_size(), np.int64)
        for token, i in tok.get_vocab().items():
            size[i] = len(token)             # one character per byte
        _STATE.clear()
        _STATE.update(name=path, tok=tok, size=size, spaced={}, plain={})
    return _STATE


def _bytes(ids: list[int]) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


def _strings(column) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()        # quicker than to_pylist


def _encode_words(words: list[str], lead: str, state: dict) -> dict[str, bytes]:
    """Ids of ``lead + word`` for distinct words without white space."""
    out: dict[str, bytes] = {}
    groups = [words[i:i + JOINED] for i in range(0, len(words), JOINED)]
    texts = [lead + lead.join(g) for g in groups]
    rest: list[str] = []
    for group, e in zip(groups, state["tok"].encode_batch_fast(texts, add_special_tokens=False)):
        ids = np.asarray(e.ids, dtype="<u4")
        upto = np.cumsum(state["size"][ids])
        ends = np.cumsum([1 + len(w.encode()) for w in group])
        cuts = np.searchsorted(upto, ends)
        if upto[-1] != ends[-1] or (upto[cuts] != ends).any():
            rest.extend(group)
            continue
        data, at = ids.tobytes(), 0
        for w, c in zip(group, (cuts * 4 + 4).tolist()):
            out[w] = data[at:c]
            at = c
    for w, e in zip(rest, state["tok"].encode_batch_fast([lead + w for w in rest], add_special_tokens=False)):
        out[w] = _bytes(e.ids)
    return out


def _encode_new(parts: list[str], state: dict) -> dict[str, bytes]:
    """Ids of ``" " + part`` for distinct parts that are not in the cache."""
    out: dict[str, bytes] = {}
    spaced, plain = state["spaced"], state["plain"]
    forms: dict[str, tuple] = {}
    rest = []
    for p in parts:
        m = _FORM.match(p)
        g = m.groups() if m else None
        if g and g[0].isalpha() and (g[3] is None or g[3].isalpha()):
            forms[p] = g
        else:
            rest.append(p)
    for p, e in zip(rest, state["tok"].encode_batch_fast([" " + p for p in rest], add_special_tokens=False)):
        out[p] = _bytes(e.ids)
    cores = {g[0] for g in forms.values()}
    known = {w: spaced[w] for w in cores if w in spaced}
    known.update(_encode_words([w for w in cores if w not in known], " ", state))
    others = {x for g in forms.values() for x in (g[1], g[4]) if x}
    small = {x: plain[x] for x in others if x in plain}
    new = [x for x in others if x not in small]
    for x, e in zip(new, state["tok"].encode_batch_fast(new, add_special_tokens=False)):
        small[x] = plain[x] = _bytes(e.ids)
    line = _bytes(state["tok"].encode("\n", add_special_tokens=False).ids)
    heads = _encode_words(list({g[3] for g in forms.values() if g[3]}), "\n", state)
    small[""] = b""
    for p, (core, tail, brk, head, end) in forms.items():
        ids = known[core] + small[tail]
        if brk:
            behind = heads[head]
            if not behind.startswith(line):      # the break and the word are two pre-tokens
                behind = line + _bytes(state["tok"].encode(head, add_special_tokens=False).ids)
            ids += behind + small[end or ""]
        out[p] = ids
    for w in cores:
        if w not in out and len(w) <= LONG_PART:
            spaced[w] = known[w]
    return out


def encode_texts(texts: list[str | None], path: str) -> list[bytes]:
    """Little-endian unsigned 32-bit ids of each text (null: none)."""
    import pyarrow as pa
    return [x for _, _, ids in encode_column(pa.array(texts, pa.string()), path) for x in ids]


def encode_column(column, path: str) -> Iterator[tuple[int, int, list[bytes]]]:
    """Rows of an Arrow column of texts, about ``SLICE_BYTES`` at a time, with the ids of each text."""
    import pyarrow.compute as pc
    state = _load(path)
    sizes = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    for at, end in spans(sizes, SLICE_BYTES):
        yield at, end, _encode_slice(column.slice(at, end - at).fill_null(""), state)


def _encode_slice(column, state: dict) -> list[bytes]:
    import pyarrow as pa
    import pyarrow.compute as pc
    tok, spaced, plain = state["tok"], state["spaced"], state["plain"]
    if len(spaced) + len(plain) > CACHE_MAX:
        spaced.clear()
        plain.clear()
    whole = pc.match_substring(column, "<|")             # may hold a special token, which is found in whole texts
    inside = pc.and_not(pc.match_substring_regex(column, _INSIDE), whole)
    out: list = [None] * len(column)
    for i in np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist():
        out[i] = _bytes(tok.encode(column[i].as_py(), add_special_tokens=False).ids)
    # texts with runs of white space: a part is a run and what follows it
    runs = {i: _RUNS.findall(column[i].as_py()) for i in np.flatnonzero(inside.to_numpy(zero_copy_only=False)).tolist()}
    # all other texts: a first part, and parts behind a space each
    cut = pc.invert(pc.or_(whole, inside))
    lists = pc.split_pattern(column.filter(cut), " ")
    flat = lists.flatten()
    ends = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))))
    first = _strings(flat.take(pa.array(ends[:-1])))
    coded = flat.dictionary_encode()
    table = _encode_spaced(coded.dictionary, state)
    heads = {"": b""}
    new = []
    for p in set(first).union(*runs.values()):
        if p in plain:
            heads[p] = plain[p]
        elif p:
            new.append(p)
    for p, e in zip(new, tok.encode_batch_fast(new, add_special_tokens=False)):
        heads[p] = _bytes(e.ids)
        if len(p) <= LONG_PART:
            plain[p] = heads[p]
    ids = list(map(table.__getitem__, coded.indices.to_numpy(zero_copy_only=False).tolist()))
    ends = ends.tolist()
    for k, p in zip(ends, first):
        ids[k] = heads[p]
    for i, a, b in zip(np.flatnonzero(cut.to_numpy(zero_copy_only=False)).tolist(), ends[:-1], ends[1:]):
        out[i] = b"".join(ids[a:b])
    for i, parts in runs.items():
        out[i] = b"".join([heads[p] for p in parts])
    return out


def _encode_spaced(parts, state: dict) -> list[bytes]:
    """Ids of ``" " + part`` for an Arrow column of distinct parts."""
    import pyarrow as pa
    import pyarrow.compute as pc
    spaced, plain = state["spaced"], state["plain"]
    # a word of letters and the punctuation behind it are a pre-token each
    cores = pc.ascii_rtrim(parts, characters=_TAIL)
    coded = cores.dictionary_encode()
    words = _strings(coded.dictionary)
    alpha = list(map(str.isalpha, words))
    known = [spaced.get(w) if a else None for w, a in zip(words, alpha)]
    new = _encode_words([w for w, a, x in zip(words, alpha, known) if a and x is None], " ", state)
    known = [new.get(w) if a and x is None else x for w, a, x in zip(words, alpha, known)]
    spaced.update(new if max(map(len, new), default=0) <= LONG_PART else {w: x for w, x in new.items() if len(w) <= LONG_PART})
    index = coded.indices.to_numpy(zero_copy_only=False)
    table = list(map(known.__getitem__, index.tolist()))
    word = np.array(alpha, bool)[index]
    tailed = np.flatnonzero(word & pc.not_equal(pc.binary_length(parts), pc.binary_length(cores)).to_numpy(zero_copy_only=False))
    tails = [p[len(words[c]):] for p, c in zip(_strings(parts.take(pa.array(tailed))), index[tailed].tolist())]
    others = [x for x in set(tails) if x not in plain]
    small = dict(zip(others, map(_bytes, (e.ids for e in state["tok"].encode_batch_fast(others, add_special_tokens=False)))))
    plain.update((x, i) for x, i in small.items() if len(x) <= LONG_PART)
    for k, x in zip(tailed.tolist(), tails):
        table[k] += plain[x] if x in plain else small[x]
    # numbers, contractions, line breaks and so on
    rest = np.flatnonzero(~word)
    strings = _strings(parts.take(pa.array(rest)))
    found = {p: x for p in strings if (x := spaced.get(p)) is not None}
    new = _encode_new([p for p in strings if p not in found], state)
    spaced.update((p, x) for p, x in new.items() if len(p) <= LONG_PART)
    for k, p in zip(rest.tolist(), strings):
        table[k] = found[p] if p in found else new[p]
    return table
