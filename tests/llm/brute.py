"""Plain restatements of what the operators must return, over small lists of documents."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@lru_cache
def tokenizer(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def ids_of(name, text):
    return tokenizer(name).encode(text or "", add_special_tokens=False).ids


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed"""
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(covered), len(words) < 10 or 100 * len(covered) > 20 * len(words))


def token_file(docs):
    """{doc_id: (start, n_tokens, crc)} in ascending order of distinct ids"""
    out, start = {}, 0
    for doc, text in sorted(docs):
        ids = [*ids_of("word_bpe_49k.json", text), 2]
        out[doc] = (start, len(ids), zlib.crc32(packed(ids)))
        start += len(ids)
    return out


def byte_bpe(text):
    ids = ids_of("byte_bpe_50k.json", text)
    back = tokenizer("byte_bpe_50k.json").decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


@lru_cache
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def n_pieces(text):
    return len(pieces().encode(text or ""))


def shingles(text):
    words = [w.encode().lower() for w in WORD.findall(text or "")]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def components(docs):
    """{doc_id: (n_shingles, component_id)}; every pair of documents that share a shingle is compared"""
    sets = {d: shingles(t) for d, t in docs}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            root[d] = root[root[d]]
            d = root[d]
        return d

    by = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            by[x].append(d)
    for a, b in {(a, b) for own in by.values() for i, a in enumerate(own) for b in own[i + 1:]}:
        common = len(sets[a] & sets[b])
        if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def dedup(texts, width=200):
    """(n_bytes, n_removed, n_spans, kept bytes) of each text"""
    data = [(t or "").encode() for t in texts]
    often = Counter(d[i:i + width] for d in data for i in range(len(d) - width + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - width + 1):
            if often[d[i:i + width]] > 1:
                gone[i:i + width] = b"\1" * width
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), kept))
    return out


def secrets(text):
    """[(kind, start, end)] of the base patterns"""
    text = text or ""
    out = []
    for m in re.finditer(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 8:
            out.append(("assign", m.start(), m.end()))
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    order = {"assign": 0, "access": 1, "hex": 2}
    return sorted(out, key=lambda x: (x[1], order[x[0]]))
