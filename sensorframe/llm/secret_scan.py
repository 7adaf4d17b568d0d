"""Secrets in texts: keyword search with an Aho-Corasick automaton, regular expressions anchored at its hits, checksums."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The base kinds with their patterns, and the fewest characters of a match (of group 2 for ``assign``).
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LENGTH, ACCESS_LENGTH = 12, 18

_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62_crc(token: str) -> bool:
    """The last six of the 36 characters after the prefix are the CRC-32 of the others in base 62."""
    body = token.rpartition("_")[2]
    crc, digits = zlib.crc32(body[:-6].encode()), ""
    for _ in range(6):
        crc, digit = divmod(crc, 62)
        digits = _BASE62[digit] + digits
    return digits == body[-6:]


def json_header(token: str) -> bool:
    """The first part of a signed web token is base64 of a JSON object that names an algorithm."""
    head = token.split(".")[0]
    try:
        value = json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (binascii.Error, ValueError):
        return False
    return isinstance(value, dict) and "alg" in value


def base64_body(block: str) -> bool:
    """A key block between its armour lines is valid base64 of some length."""
    body = re.sub(r"\s", "", re.sub(r"(?m)^[A-Za-z-]+: .*$", "", block.split("-----")[2]))
    try:
        return len(base64.b64decode(body, validate=True)) >= 32
    except binascii.Error:
        return False


def _any(_: str) -> bool:
    return True


#: Kind, keywords, pattern that begins with a keyword, and the check of a match.
ADDED: list[tuple[str, tuple[str, ...], re.Pattern, Callable[[str], bool]]] = [
    ("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9_])"), base62_crc),
    ("npm", ("npm_",), re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9_])"), base62_crc),
    ("slack", ("xoxb-", "xoxa-", "xoxp-", "xoxr-", "xoxs-"), re.compile(r"xox[bapors]-[0-9A-Za-z]+(?:-[0-9A-Za-z]+)+"), _any),
    ("stripe", ("sk_live_", "rk_live_"), re.compile(r"[sr]k_live_[0-9A-Za-z]{24,}"), _any),
    ("google", ("AIza",), re.compile(r"AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])"), _any),
    ("jwt", ("eyJ",), re.compile(r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"), json_header),
    ("pem", ("-----BEGIN ",), re.compile(r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----[^-]+-----END (?:[A-Z]+ )?PRIVATE KEY-----"), base64_body),
]
KINDS = ["assign", "access", "hex", *(k for k, *_ in ADDED)]

#: The first part of a web token goes on to the end of its characters, so where it fails, all later starts within these fail as well.
_JWT, _PART = KINDS.index("jwt"), re.compile(r"[A-Za-z0-9_-]+")

#: A keyword of an added kind counts only at the start of a token.
_INSIDE = re.compile(r"[A-Za-z0-9_]")


def _lower(text: str) -> str:
    """A-Z in lower case, at the same positions."""
    low = text.lower()
    return low if len(low) == len(text) else re.sub("[A-Z]+", lambda m: m[0].lower(), text)


class Scanner:
    """Finds the spans ``(kind number, start, end)`` of a text, in code points, end exclusive."""

    def __init__(self):
        self.automaton = ahocorasick.Automaton()
        words: dict[str, list[int]] = {w: [0] for w in ("password", "passwd", "secret", "token", "apikey", "api_key")}
        words["akia"] = [1]
        for kind, (_, keys, _, _) in enumerate(ADDED, 3):
            for k in keys:
                words.setdefault(k.lower(), []).append(kind)
        for w, kinds in words.items():
            self.automaton.add_word(w, (len(w), kinds))
        self.automaton.make_automaton()
        self.patterns = [ASSIGN, ACCESS, HEX, *(p for _, _, p, _ in ADDED)]
        self.checks = [
            lambda m: len(m[2]) >= ASSIGN_LENGTH, lambda m: m.end() - m.start() >= ACCESS_LENGTH, _any,
            *((lambda m, check=c: check(m[0])) for *_, c in ADDED),
        ]

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """Matches of a kind don't overlap: one that fails its check still uses up its characters."""
        found = [(2, *m.span()) for m in HEX.finditer(text)]
        used = [0] * len(KINDS)
        for last, (size, kinds) in self.automaton.iter(_lower(text)):
            at = last - size + 1
            for kind in kinds:
                if at < used[kind] or kind > 2 and at and _INSIDE.match(text, at - 1):
                    continue
                m = self.patterns[kind].match(text, at)
                if m:
                    used[kind] = m.end()
                    if self.checks[kind](m):
                        found.append((kind, *m.span()))
                elif kind == _JWT:
                    used[kind] = _PART.match(text, at).end()
        return sorted(found, key=lambda s: (s[1], s[0]))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{i}:{j}" for k, i, j in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
_scanners: list[Scanner] = []


def scan(documents: DataFrame) -> DataFrame:
    """Counts and spans of the secrets of every document.

    A null text counts as empty and has no span. Rows are scanned one by one, where they lie: repeated
    rows and null ids stay. Added kinds may overlap base spans; both are listed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _scanners:
            _scanners.append(Scanner())
        for b in batches:
            counts, digests, texts = ([], [], []), [], []
            for t in b.column("text"):
                spans = _scanners[0].spans(t.as_py() or "")
                base = [s for s in spans if s[0] < 3]
                for kind, c in enumerate(counts):
                    c.append(sum(s[0] == kind for s in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                texts.append(joined(spans))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(texts, pa.string())],
                [c.split()[0] for c in SCHEMA.split(", ")],
            )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
