"""URL filters: many glob rules simulated at once by a bit-parallel automaton.

Every rule is a glob over the canonical form ``"." + host + path`` of a URL:

* a letter stands for itself, ``?`` for any one byte,
* ``*`` for any run of bytes without ``/`` (it stays inside a host or a path segment),
* ``**`` for any run of bytes.

All rules are packed into one bit vector that spans several 64-bit words; state *i* of a rule
has one bit.  One Shift-And step per byte of the URL moves every rule at once:
``D = (carry_shift(D) & MOVE[c]) | (D & STAY[c])``, where ``STAY`` has the states with a
wildcard.  The steps run over all URLs of an Arrow batch together, longest first, so that a
step touches only the URLs that still have a byte to read.

Nulls: a null URL, or one without ``://``, has an empty host and path and no rule fits it.
Empty tables give empty results; other columns are left alone.  Long URLs only take more steps.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
REST = r"(?s)^.*?://(.*)$"


@dataclass(frozen=True)
class UrlRule:
    """``name``: what the result shows, if ``shown``.  ``weight``: among fitting rules the heaviest wins."""

    name: str
    verdict: str
    globs: tuple[str, ...]
    weight: int
    shown: bool = True

    @staticmethod
    def prefix(rule: str, verdict: str) -> UrlRule:
        """A rule ``host/path-prefix``: that host and all its subdomains, paths that start so."""
        host, slash, path = rule.partition("/")
        return UrlRule(rule, verdict, (f"*.{host}{slash}{path}**",), 1_000_000 + len(rule))

    @staticmethod
    def host_glob(glob: str, verdict: str, weight: int = 1) -> UrlRule:
        """A glob over ``"." + host`` alone, without ``**``: it never reaches the path."""
        if "**" in glob or "/" in glob:
            raise ValueError(f"not a glob over hosts: {glob}")
        return UrlRule(glob, verdict, (glob, f"{glob}/**"), weight, shown=False)

    @staticmethod
    def path_glob(glob: str, verdict: str, weight: int = 1) -> UrlRule:
        """A glob over the path, which starts with ``/``, on any host."""
        if not glob.startswith("/"):
            raise ValueError(f"not a glob over paths: {glob}")
        return UrlRule(glob, verdict, (f"*{glob}",), weight, shown=False)


#: Path rules of the production filter; the longest that fits decides.
PATH_RULES = tuple(
    UrlRule.prefix(rule, verdict)
    for verdict, rule in (
        ("block", "com/en/"),
        ("allow", "example.com/en/7"),
        ("allow", "net/de/"),
        ("block", "example.net/de/8"),
        ("block", "org/es/"),
    )
)
#: Globs that decide where no path rule fits: hosts named for gambling, adult, spam or advertising, and
#: paths that hold no text (accounts, shops' baskets, server folders, downloads).
OTHER_RULES = (
    *(
        UrlRule.host_glob(glob, "block")
        for glob in (
            *(f"*.*{word}*" for word in ("casino", "free-bets", "betting", "jackpot", "poker-", "adult-", "xxx", "porn", "escort", "spam-farm", "cheap-pills", "pharma-", "viagra", "replica-", "payday-", "ads-track", "click-track", "doubleclick", "link-farm", "torrent")),
            *(f"*.{label}.*" for label in ("ad", "ads", "adserver", "tracker", "pixel", "banner")),
        )
    ),
    *(
        UrlRule.path_glob(glob, "block")
        for glob in (
            *(f"/**/{name}" for name in ("login", "logout", "signin", "signup", "register", "cart", "checkout", "wp-login.php", "xmlrpc.php")),
            *(f"/{name}" for name in ("login", "logout", "signin", "signup", "register", "cart", "checkout", "wp-login.php", "xmlrpc.php")),
            *(f"/{folder}/**" for folder in ("wp-admin", "cgi-bin", "admin", "account", "cart", "checkout", "basket")),
            *(f"/**.{kind}" for kind in ("exe", "zip", "gz", "rar", "iso", "apk", "dmg", "mp4", "mp3", "jpg", "png", "gif", "css", "js")),
        )
    ),
)


class GlobAutomaton:
    """Multiword Shift-And masks of a list of globs."""

    def __init__(self, globs: list[str]):
        moves: list[tuple[int, str]] = []  # (bit reached, byte or any)
        loops: list[tuple[int, str]] = []
        starts, self.ends, bit = [], [], 0
        for glob in globs:
            starts.append(bit)
            raw, i = glob.encode(), 0
            while i < len(raw):
                c = raw[i : i + 1]
                if c == b"*":
                    both = raw[i : i + 2] == b"**"
                    loops.append((bit, "any" if both else "segment"))
                    i += 1 + both
                    continue
                bit += 1
                moves.append((bit, c))
                i += 1
            self.ends.append(bit)
            bit += 1
        self.words = max(1, -(-bit // 64))
        self.start = self._mask(starts)
        self.move = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        for at, c in moves:
            for b in range(256) if c == b"?" else c:
                self.move[b] |= self._mask([at])
        for at, kind in loops:
            for b in range(256):
                if kind == "any" or b != ord("/"):
                    self.stay[b] |= self._mask([at])

    def _mask(self, bits: list[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for b in bits:
            out[b // 64] |= np.uint64(1) << np.uint64(b % 64)
        return out

    def match(self, texts: list[bytes]) -> np.ndarray:
        """For each text, a row of booleans: which globs fit all of it."""
        n = len(texts)
        lengths = np.fromiter(map(len, texts), np.int64, n)
        order = np.argsort(-lengths, kind="stable")
        state = np.tile(self.start, (n, 1))
        data = np.frombuffer(b"".join(texts), np.uint8)
        begin = (np.cumsum(lengths) - lengths)[order]
        left = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), side="left")
        for t, live in enumerate(left):
            c, d = data[begin[:live] + t], state[:live]
            up = d << np.uint64(1)
            if self.words > 1:
                up[:, 1:] |= d[:, :-1] >> np.uint64(63)
            state[:live] = (up & self.move[c]) | (d & self.stay[c])
        out = np.empty((n, len(self.ends)), bool)
        for k, end in enumerate(self.ends):
            out[order, k] = (state[:, end // 64] >> np.uint64(end % 64)) & np.uint64(1) == 1
        return out


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return F.translate(F.regexp_extract(rest_of(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(rest_of(url), r"^[^/?#]*([^?#]*)", 1)


def rest_of(url: Column) -> Column:
    return F.when(F.coalesce(url, F.lit("")).contains("://"), F.regexp_extract(url, REST, 1)).otherwise("")


def filter_urls(pages: DataFrame, url: str = "url", rules: tuple[UrlRule, ...] = PATH_RULES + OTHER_RULES, default: str = "allow") -> DataFrame:
    """``pages`` with the columns host, path, rule and verdict added (clashing names are replaced).

    The fitting rule of greatest weight gives the verdict, ``default`` if none fits; ``rule`` is its
    name, null if none fits or the rule is not one of those shown (host and path globs aren't).
    """
    globs = [(g, r) for r, rule in enumerate(rules) for g in rule.globs]
    weight = np.array([rule.weight for rule in rules], np.int64)
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    split = pages.select(*[F.col(f"`{c}`") for c in keep], host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    schema = T.StructType([*split.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])

    def apply(batches):
        automaton = GlobAutomaton([g for g, _ in globs])
        owner = np.array([r for _, r in globs])
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            hit = automaton.match([f".{h}{p}".encode() for h, p in zip(hosts, paths)])
            score = np.where(hit, weight[owner], -1)
            best = score.argmax(axis=1) if len(globs) and len(hosts) else np.zeros(len(hosts), int)
            found = [rules[owner[b]] if score[i, b] >= 0 else None for i, b in enumerate(best)] if globs else [None] * len(hosts)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([f.name if f and f.shown else None for f in found], pa.string()), pa.array([f.verdict if f else default for f in found], pa.string())],
                names=[*batch.schema.names, "rule", "verdict"],
            )

    return split.mapInArrow(apply, schema)
