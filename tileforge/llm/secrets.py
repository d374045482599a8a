"""Secret scans: base patterns, and a linear-chain conditional random field over the tokens of a text.

Tokens are runs of the characters that secrets are made of. The field tags them as begin (B), inside (I) or outside (O) of a
secret; its features are the token's shape, the neighbouring words, the characters between them and the file's make-up. It
is trained on a bounded sample of the corpus into which made-up secrets of many forms are planted, so that it learns what
secrets look like in these texts and not what the base patterns match; look-alikes (addresses, numbers, dates, paths) are
planted as plain text; so are file names, checksums, versions and identifiers of many kinds. A tag I follows B or I only. Decoding is by Viterbi over whole texts: where the emission for O leads
by more than all other scores together could make up, every best path is at O, so the chain falls apart there and only the
short stretches in between are searched.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

KINDS = ("assign", "access", "hex", "crf")
#: The base patterns. A match counts from 12 (second group), 18 and 16 characters on.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal, so that shorter ones need not be matched and dropped
LEAST = {"assign": 12, "access": 18, "hex": 16}
KEYWORDS = ("password", "passwd", "secret", "token", "api")

#: Documents expected in the training sample, characters of each that are used, secrets and look-alikes planted into all of
#: them together, and tokens on each side of a training window's middle.
SAMPLE_DOCS, SAMPLE_CHARS, PLANTED, SIDE = 800, 4000, 2000, 5
O, B, I = 0, 1, 2
#: Parts of words that often stand before a secret.
STEMS = ("pass", "pwd", "secret", "token", "key", "auth", "bearer", "cred", "private")

_LOWER, _UPPER, _DIGIT, _SIGN, _WIDE, _GAP = range(6)
_CLASS = np.full(256, _GAP, np.uint8)
_CLASS[list(b"abcdefghijklmnopqrstuvwxyz")] = _LOWER
_CLASS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = _UPPER
_CLASS[list(b"0123456789")] = _DIGIT
_CLASS[list(b"+/_.-")] = _SIGN
_CLASS[128:] = _WIDE
_HEXLETTER = np.zeros(256, bool)
_HEXLETTER[list(b"abcdefABCDEF")] = True
_QUOTE, _ASSIGN, _CODE = (np.zeros(256, bool) for _ in range(3))
_QUOTE[list(b"\"'`")] = True
_ASSIGN[list(b"=:")] = True
_CODE[list(b"{}[]()<>;=#$@|\\\"")] = True
_JOIN, _SPACE = np.zeros(256, bool), np.zeros(256, bool)
_JOIN[list(b"!$%&*~^")] = True
_SPACE[list(b" \t\n\r\x0b\x0c")] = True
_LENGTHS = np.array([4, 8, 12, 16, 20, 32, 40, 64])
#: Lengths of rough stretches, which change between digits and letters or to capitals very often.
_ROUGH = np.array([1, 8, 10, 12, 16, 20, 28])
#: Feature groups: name and number of values. A token has one value of each.
GROUPS = {"length": 9, "classes": 32, "hexlike": 10, "digit_turns": 8, "case_turns": 8, "signs": 6, "longest_word": 8, "run": 6, "word_before": 4, "second_before": 4, "gap": 16, "after": 4, "rough": 8, "pieces": 7, "address": 3, "ending": 3, "joined": 3, "checksum": 2, "file_odd": 4, "file_code": 4, "file_lines": 4}
_OFFSETS = dict(zip(GROUPS, np.cumsum([0, *GROUPS.values()])))
FEATURES = sum(GROUPS.values())
_BAN = -1e9


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns' matches, sorted by start, then kind."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def value_spans(text: str) -> list[tuple[int, int]]:
    """The secrets themselves: of an assignment its value only. Matches of digits alone, which may be any number, are left out."""
    out = [(m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    out += [(a, z) for a, k, z in base_spans(text) if k > 0]
    return sorted({(a, z) for a, z in out if not text[a:z].isdigit()})


@dataclass
class Tokens:
    """The tokens of some texts that were put together with a line feed after each."""

    start: np.ndarray
    end: np.ndarray
    features: np.ndarray


def tokens_of(data: bytes, ends: np.ndarray) -> Tokens:
    """``ends``: where each text of ``data`` ends."""
    raw = np.frombuffer(data, np.uint8)
    kind = _CLASS[raw]
    inside = np.concatenate([[False], kind != _GAP, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    n = len(start)
    if not n:
        return Tokens(start, end, np.empty((0, len(GROUPS)), np.int16))

    def count(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int32)])
        return sums[end] - sums[start]

    lower, upper, digit, sign, wide = (count(kind == k) for k in range(5))
    hexes = count(_HEXLETTER[raw]) + digit

    def turns(one: int, other: int | None = None) -> np.ndarray:
        """How often the token changes between a class and another one, or any."""
        here, last = kind[1:], kind[:-1]
        change = (here == one) != (last == one) if other is None else ((here == one) & (last == other)) | ((here == other) & (last == one))
        return count(np.concatenate([[False], change & (last != _GAP) & (here != _GAP)]))

    # how far each byte is into its run of one class; the longest runs of letters of one case and of any class in a token
    change = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
    into = np.arange(len(kind), dtype=np.int32) - np.repeat(change, np.diff(np.append(change, len(kind)))).astype(np.int32) + 1
    edges = np.append(edge, len(kind)) if edge[-1] < len(kind) else edge
    longest = np.maximum.reduceat(np.where(kind <= _UPPER, into, 0), edges[: 2 * n])[::2] if n else np.empty(0, np.int32)
    run = np.maximum.reduceat(into, edges[: 2 * n])[::2]
    length = end - start
    size = np.searchsorted(_LENGTHS, length, side="right")
    f = np.empty((n, len(GROUPS)), np.int16)
    f[:, 0] = size
    f[:, 1] = (lower > 0) + 2 * (upper > 0) + 4 * (digit > 0) + 8 * (sign > 0) + 16 * (wide > 0)
    f[:, 2] = np.where((hexes == length) & (digit > 0) & (digit < length), 1 + size, 0)
    f[:, 3] = np.minimum(7, (turns(_DIGIT) + 1) // 2)
    f[:, 4] = np.minimum(7, (turns(_LOWER, _UPPER) + 1) // 2)
    f[:, 5] = np.minimum(5, sign)
    f[:, 6] = np.minimum(7, longest)
    f[:, 7] = np.minimum(5, run * 6 // np.maximum(1, length))
    doc = np.searchsorted(ends, start, side="right")
    first = np.concatenate([[True], doc[1:] != doc[:-1]])
    hint = np.zeros(n, np.int16)
    low = data.lower()
    for stem in STEMS:
        own = _places(low, stem.encode(), start, end)
        hint[own] = np.maximum(hint[own], np.where(length[own] > 24, 0, np.where(length[own] == len(stem), 2, 1)))
    f[:, 8] = np.where(first, 3, np.concatenate([[0], hint[:-1]]))
    f[:, 9] = np.where(first | np.concatenate([[True], first[:-1]]), 3, np.concatenate([[0, 0], hint[:-2]])[:n])
    left = np.where(first, start, np.concatenate([[0], end[:-1]]))
    between = lambda flags: (lambda sums: sums[start] > sums[left])(np.concatenate([[0], np.cumsum(flags, dtype=np.int32)]))
    f[:, 10] = between(_ASSIGN[raw]) + 2 * between(_QUOTE[raw]) + 4 * between(raw == 10) + 8 * (start - left > 4)
    after = raw[np.minimum(len(raw) - 1, end)]
    f[:, 11] = np.select([_QUOTE[after], (after == 32) | (after == 10), after == 64], [1, 0, 3], 2)
    # pieces between signs: how many, and how long the longest rough one is
    pure = np.concatenate([[False], (kind != _GAP) & (kind != _SIGN), [False]])
    piece = np.flatnonzero(pure[1:] != pure[:-1])
    of = np.searchsorted(start, piece[::2], side="right") - 1
    here, last = kind[1:], kind[:-1]
    change = ((here == _DIGIT) & (last <= _UPPER)) | ((last == _DIGIT) & (here <= _UPPER)) | ((here == _UPPER) & (last == _LOWER))
    sums = np.concatenate([[0, 0], np.cumsum(change, dtype=np.int32)])
    wide_ = piece[1::2] - piece[::2]
    changes = sums[piece[1::2]] - sums[piece[::2] + 1]
    rough = np.zeros(n, np.int64)
    np.maximum.at(rough, of, np.where(changes >= np.maximum(2, 0.2 * wide_), wide_, 0))
    f[:, 12] = np.searchsorted(_ROUGH, rough, side="right")
    f[:, 13] = np.minimum(6, np.bincount(of, minlength=n))
    # tokens without white space between them form one word; of an address its host and path, and what follows these
    apart = first | between(_SPACE[raw])
    word = np.cumsum(apart) - 1
    slashes = (length > 2) & (raw[start] == 47) & (raw[np.minimum(len(raw) - 1, start + 1)] == 47)
    opened = np.full(word[-1] + 1, n)
    np.minimum.at(opened, word[slashes], np.flatnonzero(slashes))
    f[:, 14] = np.where(np.arange(n) < opened[word], 0, np.where(slashes, 1, 2))
    # a name with an extension of two to four letters, or with a version's digits at its end
    dot = np.zeros(n, bool)
    for back in (3, 4, 5):
        dot |= (length > back) & (raw[np.maximum(0, end - back)] == 46)
    f[:, 15] = np.where(dot, 1, np.where((digit > 0) & (kind[end - 1] == _DIGIT) & (sign > 0), 2, 0))
    single = (start - left == 1) & ~first
    f[:, 16] = np.where(single & _JOIN[raw[np.maximum(0, start - 1)]], 1, 0) + np.where(_JOIN[after] & (kind[np.minimum(len(raw) - 1, end + 1)] != _GAP), 1, 0)
    sha = _starting(low, (b"sha1-", b"sha256-", b"sha384-", b"sha512-", b"md5-"), start)
    f[:, 17] = sha | np.concatenate([[False], (_starting(low, (b"sha1", b"sha256", b"sha384", b"sha512", b"md5"), start) & (length <= 6))[:-1]]) & ~first
    tokens = np.maximum(1, np.bincount(doc, minlength=len(ends)))
    size_of = np.maximum(1, np.diff(np.concatenate([[0], ends])))
    per_doc = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)[np.asarray(ends) - 1]]))
    f[:, 18] = np.searchsorted([0.001, 0.01, 0.1], np.bincount(doc, (digit > 0) & (length >= 12), minlength=len(ends)) / tokens)[doc]
    f[:, 19] = np.searchsorted([0.005, 0.02, 0.06], per_doc(_CODE[raw]) / size_of)[doc]
    f[:, 20] = np.searchsorted([20, 60, 200], size_of / np.maximum(1, per_doc(raw == 10)))[doc]
    f += np.array(list(_OFFSETS.values()), np.int16)
    return Tokens(start, end, f)


def _starting(low: bytes, words: tuple[bytes, ...], start: np.ndarray) -> np.ndarray:
    """Which tokens begin with one of the words."""
    out = np.zeros(len(start), bool)
    for word in words:
        at, found = low.find(word), []
        while at >= 0:
            found.append(at)
            at = low.find(word, at + len(word))
        out |= np.isin(start, np.array(found, np.int64))
    return out


def _places(low: bytes, word: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The tokens that hold the word."""
    at, found = low.find(word), []
    while at >= 0:
        found.append(at)
        at = low.find(word, at + len(word))
    k = np.searchsorted(start, np.array(found, np.int64), side="right") - 1
    return np.unique(k[(k >= 0) & (end[k] >= np.array(found, np.int64) + len(word))]) if found else np.empty(0, np.int64)


@dataclass
class Field:
    """``emit`` is features x 3, ``step`` from tag to tag, ``begin`` for the first token."""

    emit: np.ndarray
    step: np.ndarray
    begin: np.ndarray

    def decode(self, tokens: Tokens, doc: np.ndarray) -> np.ndarray:
        """The best tag of every token; a path runs within one text."""
        n = len(tokens.start)
        tags = np.zeros(n, np.int8)
        if not n:
            return tags
        score = np.zeros((n, 3))
        for k in range(len(GROUPS)):
            score += self.emit[tokens.features[:, k]]
        first = np.concatenate([[True], doc[1:] != doc[:-1]])
        score[first] += self.begin
        # the most that a tag B or I can win over O by its steps; where an I follows, that one would have to become B
        tags_, last = (O, B, I), [None]
        at = lambda p, x: self.begin[x] if p is None else 0.0 if x is None else self.step[p, x]
        alone = [at(p, x) + at(x, z) - at(p, O) - at(O, z) for p in (*tags_, *last) for x in (B, I) for z in (O, B, *last) if at(p, x) > _BAN / 2]
        led = [at(p, x) + at(x, I) + at(I, z) - at(p, O) - at(O, B) - at(B, z) for p in (*tags_, *last) for x in (B, I) for z in (*tags_, *last) if at(p, x) > _BAN / 2]
        follows = np.append(np.where(first[1:], -np.inf, score[1:, I] - score[1:, B]), -np.inf)
        bound = np.maximum(max(alone), max(led) + follows)
        open_ = np.flatnonzero(score[:, O] - np.maximum(score[:, B], score[:, I]) <= bound)
        if not len(open_):
            return tags
        cut = np.flatnonzero((np.diff(open_) > 1) | first[open_[1:]])
        for run in np.split(open_, cut + 1):
            a, z = int(run[0]), int(run[-1])
            left, right = not first[a], z + 1 < n and not first[z + 1]
            if a == z:
                best = score[a] + (self.step[O] if left else 0) + (self.step[:, O] if right else 0)
                tags[a] = best.argmax()
                continue
            best = score[a] + (self.step[O] if left else 0)
            back = []
            for i in range(a + 1, z + 1):
                every = best[:, None] + self.step
                back.append(every.argmax(axis=0))
                best = every.max(axis=0) + score[i]
            tag = int((best + (self.step[:, O] if right else 0)).argmax())
            for i in range(z, a, -1):
                tags[i] = tag
                tag = int(back[i - a - 1][tag])
            tags[a] = tag
        return tags


_HEX, _BASE62, _BASE64 = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
_ALPHABETS = (_HEX, _HEX.upper(), _BASE62, _BASE62, _BASE62 + "-_", _BASE62 + "-_", _BASE64, _BASE64, string.ascii_uppercase + "234567", string.ascii_lowercase + string.digits)
_WORDS = ("pass", "passphrase", "client_secret", "auth_key", "access_key", "private_key", "session", "signature", "API-KEY", "db_pwd", "sig", "master", "value", "id", "login", "hash", "conn")
#: Forms of the secrets that are planted for training: w stands for a word before it, v for the secret.
FORMS = ('{w} = "{v}"', "{w}: {v}", "{w}={v}", "{w} {v}", '"{w}": "{v}"', "export {w}={v}", "<{w}>{v}</{w}>", "({v})", " {v} ", "'{v}'", "{w} is {v}.", "https://user:{v}@host.example/", "{w}:{v}", "{w} => '{v}',", "sk_live_{v}", "xoxb-{v}", "key-{v}", "SG.{v}", "{w} {v}:{v}", "Cookie: s={v}.{v}", "{w}: {v}.{v}.{v}")


#: Forms of passphrases, which without a word before them could be anything.
PHRASE_FORMS = ("{w}: {v}", '{w} = "{v}"', "{w}={v}", "{w} {v}", "export {w}={v}", "<{w}>{v}</{w}>", "{w} is {v}.", "https://user:{v}@host.example/")


def made_secret(rng: random.Random) -> str:
    alphabet = rng.choice(_ALPHABETS)
    value = "".join(rng.choice(alphabet) for _ in range(rng.choice((20, 24, 24, 28, 32, 32, 36, 40, 40, 48, 64, 88))))
    # a few are cut by characters that tokens do not hold
    at = rng.randrange(6, len(value) - 6)
    return value[:at] + rng.choice("!$%&*~^") + value[at:] if rng.random() < 0.15 else value


def made_phrase(rng: random.Random) -> str:
    """Some words or short stretches of letters and digits, with signs between them that tokens do not hold."""
    word = lambda: "".join(rng.choice("bcdfghklmnprstvw") + rng.choice("aeiouy") for _ in range(rng.randint(1, 4)))
    chunk = lambda: rng.choice((word, lambda: word().capitalize(), lambda: "".join(rng.choice(_BASE62) for _ in range(rng.randint(3, 9))), lambda: word().capitalize() + str(rng.randint(0, 9999))))()
    value = chunk() + "".join(rng.choice("!!!$%&*~^") + chunk() for _ in range(rng.randint(1, 3)))
    return value if len(value) >= 9 else value + "!" + chunk() + str(rng.randint(10, 9999))


def look_alikes() -> dict[str, Callable[[random.Random], str]]:
    """Kinds of things with digits, capitals or signs that are no secrets, by name."""
    digits = lambda g, k: "".join(g.choice(string.digits) for _ in range(k))
    some = lambda g, alphabet, k: "".join(g.choice(alphabet) for _ in range(k))
    word = lambda g: "".join(g.choice("bcdfglmnprst") + g.choice("aeiou") for _ in range(g.randint(1, 4)))
    slug = lambda g, least=3: "-".join(word(g) for _ in range(g.randint(least, 7)))
    host = lambda g: f"https://{g.choice(('www.', '', 'm.'))}{word(g)}{word(g)}.{g.choice(('com', 'example', 'org', 'de', 'io'))}"
    day = lambda g: f"20{g.randint(10, 29)}{g.randint(1, 12):02d}{g.randint(1, 28):02d}"
    return {
        "address": lambda g: ".".join(digits(g, g.randint(1, 3)) for _ in range(4)),
        "phone": lambda g: f"+{digits(g, 2)} {digits(g, 3)} {digits(g, 7)}",
        "time": lambda g: f"20{digits(g, 2)}-0{digits(g, 1)}-1{digits(g, 1)}T1{digits(g, 1)}:{digits(g, 2)}:{digits(g, 2)}",
        "number": lambda g: digits(g, g.randint(5, 15)),
        "mail": lambda g: f"{word(g)}.{word(g)}{digits(g, 2)}@{word(g)}.example",
        "page": lambda g: f"{host(g)}/{word(g)}/{slug(g)}.html",
        "numbered page": lambda g: f"{host(g)}/{g.choice(('', word(g) + '/'))}{slug(g)}-{digits(g, g.randint(2, 8))}",
        "dated page": lambda g: f"{host(g)}/20{digits(g, 2)}/{digits(g, 2)}/{slug(g)}/",
        "search": lambda g: f"{host(g)}/{word(g)}?{word(g)}={word(g)}&{word(g)}_id={digits(g, g.randint(3, 9))}&page={digits(g, 2)}",
        "clip": lambda g: f"{host(g)}/{g.choice(('embed/', 'clip/', 'p/', 'c?id=', 'play?x='))}{some(g, _BASE62 + '-_', g.randint(6, 13))}",
        "frame": lambda g: f"{host(g)}/w/{word(g)}?t={digits(g, 3)}&k={some(g, _BASE62 + '-_', g.randint(9, 13))}",
        "share": lambda g: f"{host(g)}/{g.choice(('s/', 'share/', 'file/d/', ''))}{some(g, _BASE62, g.randint(8, 24))}",
        "path": lambda g: f"/usr/{word(g)}/{word(g)}_{word(g)}.v{digits(g, 1)}.{digits(g, 1)}",
        "camel": lambda g: "".join(word(g).capitalize() for _ in range(g.randint(2, 4))) + digits(g, g.randint(0, 2)),
        "invoice": lambda g: f"INV-{digits(g, 4)}-{digits(g, 5)}",
        "card": lambda g: f"{digits(g, 4)}-{digits(g, 4)}-{digits(g, 4)}-{digits(g, 4)}",
        "constant": lambda g: "_".join(word(g).upper() for _ in range(3)),
        "slug": lambda g: slug(g) + g.choice(("", "", "-" + digits(g, g.randint(1, 7)))),
        "issue": lambda g: f"#{digits(g, 3)}abc",
        "long word": lambda g: word(g) * 4,
        "account": lambda g: f"DE{digits(g, 2)} {digits(g, 4)} {digits(g, 4)} {digits(g, 4)}",
        "code": lambda g: f"{word(g).upper()}{digits(g, 4)}",
        "version": lambda g: f"v{digits(g, 1)}.{digits(g, 2)}.{digits(g, 1)}-rc{digits(g, 1)}",
        "screenshot": lambda g: f"Screenshot_{day(g)}-{digits(g, 6)}_{word(g).capitalize()}.{g.choice(('png', 'PNG'))}",
        "camera": lambda g: f"{g.choice(('DSC', 'PXL', 'VID', 'MVI', 'WA'))}{g.choice(('_', '-', ''))}{g.choice((digits(g, 5), day(g) + '_' + digits(g, g.choice((6, 9)))))}{g.choice(('', '_EDIT', '-2', '.RAW', '~2'))}.{g.choice(('jpg', 'JPEG', 'mp4', 'MOV', 'dng'))}",
        "wheel": lambda g: f"{word(g)}_{word(g)}-{digits(g, 1)}.{digits(g, 2)}.{digits(g, 1)}-cp3{digits(g, 2)}-linux_x86_64.whl",
        "build": lambda g: f"{word(g)}-{digits(g, 1)}.{digits(g, 1)}.{digits(g, 2)}-{day(g)}.{g.choice(('tar.gz', 'zip', 'deb'))}",
        "machine": lambda g: f"ip-{digits(g, 2)}-{digits(g, 1)}-{digits(g, 2)}-{digits(g, 3)}.{word(g)}.internal",
        "paper": lambda g: f"arXiv:{digits(g, 4)}.{digits(g, 5)}v{digits(g, 1)}",
        "handle": lambda g: f"hdl:{digits(g, 4)}.{digits(g, 1)}/{g.choice((digits(g, 6), word(g) + '.' + digits(g, 4)))}",
        "article": lambda g: f"{g.choice(('', 'pii:', 'PMID: '))}{g.choice(('S', 's', 'j.'))}{digits(g, g.randint(4, 8))}-{digits(g, 3)}-{digits(g, 5)}-{digits(g, 1)}",
        "named id": lambda g: g.choice(("urn:uuid:", "id=", "/session/", "{")) + "-".join(some(g, _HEX, k) for k in (8, 4, 4, 4, 12)),
        "upper id": lambda g: "-".join(some(g, _HEX.upper(), k) for k in (8, 4, 4, 4, 12)),
        "lock": lambda g: f"{g.choice(('sha512', 'sha384'))}-{some(g, _BASE64, 86)}==",
        "checksum": lambda g: g.choice(('integrity="{}"', "integrity {}", "{},", '"{}"')).format(f"{g.choice(('sha1', 'sha384', 'sha512', 'md5'))}-{some(g, _BASE64, g.choice((22, 27, 43, 64, 86)))}="),
        "image": lambda g: f"{word(g)}/{word(g)}@sha512:{some(g, _HEX.upper(), 40)}",
        "hardware": lambda g: ":".join(some(g, _HEX, 2) for _ in range(6)),
        "chemical": lambda g: f"{digits(g, 1)}-({word(g)}yl)-{digits(g, 1)}H-{word(g)}ol-{digits(g, 1)},{digits(g, 1)}-dione",
        "formula": lambda g: "".join(g.choice(("C", "H", "O", "N", "Na", "Cl")) + digits(g, g.randint(1, 2)) for _ in range(g.randint(3, 6))),
        "flight": lambda g: f"{some(g, string.ascii_uppercase, 2)}{digits(g, 4)}/{digits(g, 2)}{g.choice(('JAN', 'MAR', 'JUL', 'OCT'))}",
        "part": lambda g: f"{some(g, string.ascii_uppercase, 3)}-{digits(g, 4)}-{some(g, string.ascii_uppercase, 2)}{digits(g, 2)}-{g.choice('ABC')}",
        "place": lambda g: f"{digits(g, 2)}.{digits(g, 6)},-{digits(g, 3)}.{digits(g, 5)}",
        "snake": lambda g: "_".join(word(g) for _ in range(g.randint(2, 5))) + g.choice(("", "_" + digits(g, 2))),
        "exclaimed": lambda g: g.choice(("!", " ! ", "! ")).join(word(g).capitalize() for _ in range(3)) + "!",
        "shell": lambda g: f"${word(g).upper()}/{word(g)}${digits(g, 1)}%{word(g)}&{word(g)}",
    }


LOOK_ALIKES = look_alikes()


def made_look_alike(rng: random.Random) -> str:
    # checksums are as random as secrets and need more examples
    return LOOK_ALIKES[rng.choice([*sorted(LOOK_ALIKES), "checksum", "checksum"])](rng)


def planted(texts: list[str], number: int = PLANTED, seed: int = 1) -> list[tuple[str, list[tuple[int, int]], list[tuple[int, int]]]]:
    """Each text with made-up secrets and look-alikes between its words; where the secrets are, found ones too; and where look-alikes are."""
    rng = random.Random(seed)
    each = min(12, -(-number // max(1, len(texts))))
    out = []
    for t in texts:
        gaps = [m.start() for m in re.finditer(r"[ \n]", t)] or [len(t)]
        marks, plain, parts, at, size = [], [], [], 0, 0
        for g in sorted(rng.choice(gaps) for _ in range(2 * each)):
            parts.append(t[at:g])
            size += g - at
            at = g
            if rng.random() < 0.5:
                made, forms = (made_phrase, PHRASE_FORMS) if rng.random() < 0.15 else (made_secret, FORMS)
                form = rng.choice(forms).replace("{w}", rng.choice(_WORDS))
                for k, piece in enumerate(form.split("{v}")):
                    if k:
                        value = made(rng)
                        marks.append((size, size + len(value)))
                        parts.append(value)
                        size += len(value)
                    piece = (" " if k == 0 else "") + piece
                    parts.append(piece)
                    size += len(piece)
            else:
                piece = " " + made_look_alike(rng)
                parts.append(piece)
                plain.append((size, size + len(piece)))
                size += len(piece)
        whole = "".join(parts) + t[at:]
        out.append((whole, sorted({*marks, *value_spans(whole)}), plain))
    return out


def train(texts: list[str], rounds: int = 70) -> Field:
    """The field from windows around secrets, look-alikes and other places of the planted texts, by ascent on the likelihood.

    What the corpus holds itself is taken for plain text unless it looks like a secret (long, with letters among digits or
    capitals among letters): nobody has labelled it, so windows with such a token are left out.
    """
    rows = planted(texts)
    parts = [t.encode("utf-8", "surrogatepass") + b"\n" for t, _, _ in rows]
    data, ends = b"".join(parts), np.cumsum([len(p) for p in parts])
    tokens = tokens_of(data, ends)
    made = np.zeros(len(tokens.start), bool)
    gold = np.zeros(len(tokens.start), np.int8)
    begin, width = np.array([0.0, 0.0, _BAN]), 2 * SIDE + 1
    at = 0
    for (t, marks, plain), p in zip(rows, parts):
        for spans, secret in ((plain, False), (marks, True)):
            for a, z in spans:
                a, z = at + len(t[:a].encode("utf-8", "surrogatepass")), at + len(t[:z].encode("utf-8", "surrogatepass"))
                first, last = np.searchsorted(tokens.end, a, side="right"), np.searchsorted(tokens.start, z, side="left")
                made[first:last] = True
                if secret:
                    gold[first:last] = I
                    gold[first : min(last, first + 1)] = B
        at += len(p)
    if not gold.any() or len(gold) < width:
        return Field(np.tile([1.0, 0.0, 0.0], (FEATURES, 1)), np.zeros((3, 3)), begin)
    marked = np.flatnonzero(gold == B)
    likely = np.flatnonzero((gold == O) & ((tokens.features[:, 1] - _OFFSETS["classes"] & 14) > 0) & (tokens.end - tokens.start >= 6))
    pick = random.Random(2)
    likely = np.array(sorted(pick.sample(likely.tolist(), min(len(likely), 2 * len(marked)))), np.int64)
    others = np.linspace(SIDE, len(gold) - SIDE - 1, len(marked)).astype(np.int64)
    alike = np.flatnonzero(made & (gold == O) & (tokens.end - tokens.start >= 6))
    centres = np.clip(np.concatenate([marked, alike, likely, others]), SIDE, len(gold) - SIDE - 1)
    at = centres[:, None] + np.arange(-SIDE, SIDE + 1)
    classes, digits, capitals = (tokens.features[:, k] - _OFFSETS[g] for k, g in ((1, "classes"), (3, "digit_turns"), (4, "case_turns")))
    unknown = ~made & (gold == O) & (tokens.end - tokens.start >= 16) & ((classes & 3) > 0) & ((digits >= 2) | (capitals >= 3))
    at = at[~unknown[at].any(axis=1)]
    if not gold[at].any():
        return Field(np.tile([1.0, 0.0, 0.0], (FEATURES, 1)), np.zeros((3, 3)), begin)
    x, y = tokens.features[at].astype(np.int64), gold[at].astype(np.int64)
    y[:, 0] = np.where(y[:, 0] == I, B, y[:, 0])
    m = len(at)
    emit, step = np.zeros((FEATURES, 3)), np.zeros((3, 3))
    step[O, I] = _BAN
    start = begin.copy()
    # tokens alike in all features are scored once
    kinds, of = np.unique(x.reshape(-1, x.shape[2]), axis=0, return_inverse=True)
    of = of.reshape(-1)

    def by_feature(weight: np.ndarray) -> np.ndarray:
        """Sums of windows x places x tags by feature and tag."""
        sums = np.stack([np.bincount(of, weight[:, :, s].reshape(-1), minlength=len(kinds)) for s in range(3)], axis=1)
        return np.stack([np.bincount(kinds.reshape(-1), np.repeat(sums[:, s], x.shape[2]), minlength=FEATURES) for s in range(3)], axis=1)

    tag = np.eye(3)[y]
    seen_emit = by_feature(tag)
    seen_step = np.einsum("nti,ntj->ij", tag[:, :-1], tag[:, 1:])
    mean = [np.zeros_like(emit), np.zeros_like(step)]
    square = [np.zeros_like(emit), np.zeros_like(step)]
    for r in range(1, rounds + 1):
        score = emit[kinds].sum(axis=1)[of].reshape(m, width, 3)
        score[:, 0] += start
        forward, backward = np.empty_like(score), np.zeros_like(score)
        forward[:, 0] = score[:, 0]
        for k in range(1, width):
            z = forward[:, k - 1, :, None] + step
            top = z.max(axis=1)
            forward[:, k] = np.log(np.exp(z - top[:, None]).sum(axis=1)) + top + score[:, k]
        for k in range(width - 2, -1, -1):
            z = step + (score[:, k + 1] + backward[:, k + 1])[:, None, :]
            top = z.max(axis=2)
            backward[:, k] = np.log(np.exp(z - top[:, :, None]).sum(axis=2)) + top
        top = forward[:, -1].max(axis=1)
        total = np.log(np.exp(forward[:, -1] - top[:, None]).sum(axis=1)) + top
        p = np.exp(forward + backward - total[:, None, None])
        pair = np.exp(forward[:, :-1, :, None] + step + (score[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None])
        push = [seen_emit - by_feature(p) - 0.5 * emit, seen_step - pair.sum(axis=(0, 1)) - 0.5 * np.where(step > _BAN / 2, step, 0)]
        for k, (own, g) in enumerate(zip((emit, step), push)):
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.99 * square[k] + 0.01 * g * g
            move = 0.15 * (mean[k] / (1 - 0.9**r)) / (np.sqrt(square[k] / (1 - 0.99**r)) + 1e-3 * m)
            own += np.where(own > _BAN / 2, move, 0)
    return Field(emit, step, begin)


def sample_texts(docs: DataFrame, key: str, text: str, documents: int) -> list[str]:
    """Some ``documents`` texts in expectation, or the stretch of SAMPLE_CHARS of each that a hash picks, in the order of the hash.

    Rows are taken by a hash of key and text, so that no task sorts, one scan is enough and a rerun takes the same; equal
    rows are taken once.
    """
    rows = docs.count()
    pick = F.xxhash64(F.lit("secret"), key, text)
    place = F.pmod(F.xxhash64(pick), F.greatest(F.length(text) - SAMPLE_CHARS, F.lit(0)) + 1).cast("int")
    share = min(1.0, documents / max(1, rows))
    chosen = docs.filter(F.col(text).isNotNull()).withColumn("_pick", pick).filter((F.pmod("_pick", F.lit(1 << 40)) / float(1 << 40)) < share)
    cut = chosen.select("_pick", F.substring(F.col(text), place + 1, F.lit(SAMPLE_CHARS)).alias("_text"))
    return [r["_text"] for r in sorted(cut.groupBy("_pick").agg(F.min("_text").alias("_text")).collect())]


def find(texts: list[str], field: Field) -> list[list[tuple[int, int, int]]]:
    """All spans of each text, (start, kind number, end), sorted."""
    parts = [t.encode("utf-8", "surrogatepass") + b"\n" for t in texts]
    data, ends = b"".join(parts), np.cumsum([len(p) for p in parts])
    tokens = tokens_of(data, ends)
    doc = np.searchsorted(ends, tokens.start, side="right")
    tags = field.decode(tokens, doc)
    out = [base_spans(t) for t in texts]
    # where the code points of all texts begin: a token's places are ranks among them
    points = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80, dtype=np.int64)
    begins, at = np.concatenate([[0], points[ends - 1]]), np.flatnonzero(tags != O)
    owner = doc[at]
    first, end = points[tokens.start[at]] - 1 - begins[owner], points[tokens.end[at] - 1] - begins[owner]
    free = np.ones(len(at), bool)
    for d in np.unique(owner):
        if out[d]:
            # the furthest end of the base spans that begin before the token ends
            a, z = np.searchsorted(owner, (d, d + 1))
            reach = np.concatenate([[0], np.maximum.accumulate([e for _, _, e in out[d]])])
            free[a:z] = reach[np.searchsorted(np.array([s for s, _, _ in out[d]]), end[a:z], side="left")] <= first[a:z]
    # what a base span holds is no part of another span, which goes on behind it as one of its own
    at, owner, first, end = at[free], owner[free], first[free], end[free]
    opens = (tags[at] == B) | np.concatenate([[True], (np.diff(at) > 1) | (np.diff(owner) > 0)])[: len(at)]
    closes = np.append(opens[1:], True)[: len(at)]
    for d, a, z in zip(owner[opens].tolist(), first[opens].tolist(), end[closes].tolist()):
        out[d].append((a, 3, z))
    return [sorted(x) for x in out]


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``docs`` with ``_spans``: array of (start, kind, end) in code points, end exclusive, of every whole text.

    Null and empty texts have no spans; texts of any length are scanned whole, in batches of some two million characters.
    Rows equal in text have equal spans, whatever their keys. A column ``_spans`` of ``docs`` is replaced. Spans of kind
    ``crf`` never overlap a base span.
    """
    field = train(sample_texts(docs, key, text, sample_docs))
    shared = docs.sparkSession.sparkContext.broadcast((field.emit, field.step, field.begin))

    @F.pandas_udf("array<struct<start:long,kind:string,end:long>>")
    def spans(texts: pd.Series) -> pd.Series:
        field, rows, batch, size = Field(*shared.value), [], [], 0
        for t in texts:
            batch.append(t or "")
            size += len(batch[-1])
            if size > 1 << 21:
                rows += find(batch, field)
                batch, size = [], 0
        rows += find(batch, field) if batch else []
        return pd.Series([[{"start": a, "kind": KINDS[k], "end": z} for a, k, z in r] for r in rows])

    return docs.withColumn("_spans", spans(text))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; null texts are empty, and documents without secrets have empty lists."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "_spans")

    def joined(x):
        return F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind: str):
        return F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("_spans", lambda s: s["kind"] != KINDS[3])
    return found.select("doc_id", *[number(k) for k in KINDS[:3]], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("_spans")).alias("spans"))
