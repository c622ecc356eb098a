"""URL filter: all rules in one bit-parallel wildcard automaton.

A rule is a glob over the canonical URL (host and path).  Each literal byte of each rule is a bit; bits of all
rules are packed into 64-bit words.  Reading byte c turns the states D into ``((D << 1) & B[c]) | (D & S[c])``: B says
which bits byte c may enter, S which bits stay where a wildcard stands.  The automaton steps through all URLs of a
batch at the same time, one position after another.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepweave.llm.common import boxed, unboxed

#: Words of state held at a time; bounds the memory of a batch.
STATE_WORDS = 1 << 21


@dataclass(frozen=True)
class Rule:
    """``host`` and all its subdomains, paths that start with ``path`` (which starts with ``/``)."""

    host: str
    path: str
    allow: bool

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (
    Rule("org", "/", True), Rule("example.org", "/es/", False), Rule("example.org", "/en/1", False),
    Rule("com", "/fr/", True), Rule("com", "/de/", False),
)
#: What is blocked where no rule fits.  ``*`` stops at a slash, ``**`` does not.
BLOCK_GLOBS = ("ads.*/**", "*.ads.*/**", "**/cgi-bin/**", "**/wp-login.php", "**.exe", "**.zip")

STAR, ANY = -1, -2


def tokens(glob: str) -> list[int]:
    """Bytes and wildcards of a glob; a backslash makes the next character literal."""
    out: list[int] = []
    i = 0
    while i < len(glob):
        if glob.startswith("**", i):
            out.append(ANY)
            i += 2
        elif glob[i] == "*":
            out.append(STAR)
            i += 1
        else:
            i += glob[i] == "\\" and i + 1 < len(glob)
            out += glob[i].encode("utf-8", "surrogatepass")
            i += 1
    return out


def rule_tokens(rule: Rule) -> list[list[int]]:
    """The two globs of a rule: the host itself and its subdomains."""
    tail = [*rule.name.encode(), ANY]
    return [tail, [STAR, ord("."), *tail]]


@dataclass
class Automaton:
    """Shift-And masks of several token lists, each matched against the whole text."""

    patterns: Sequence[Sequence[int]]
    enter: np.ndarray = field(init=False)
    stay: np.ndarray = field(init=False)
    start: np.ndarray = field(init=False)
    ends: list[int] = field(init=False)

    def __post_init__(self) -> None:
        states = sum(1 + sum(t >= 0 for t in p) for p in self.patterns)
        enter, stay = np.zeros((256, states), bool), np.zeros((256, states), bool)
        first = np.zeros(states, bool)
        self.ends = []
        at = 0
        for p in self.patterns:
            first[at] = True
            for t in p:
                if t >= 0:
                    at += 1
                    enter[t, at] = True
                else:
                    stay[:, at] = True if t == ANY else stay[:, at] | (np.arange(256) != ord("/"))
            self.ends.append(at)
            at += 1
        self.enter, self.stay, self.start = self._words(enter), self._words(stay), self._words(first[None])[0]

    @staticmethod
    def _words(bits: np.ndarray) -> np.ndarray:
        packed = np.packbits(bits, axis=1, bitorder="little")
        padded = np.zeros((len(bits), -(-packed.shape[1] // 8) * 8 or 8), np.uint8)
        padded[:, :packed.shape[1]] = packed
        return padded.view("<u8")

    def matches(self, texts: list[bytes]) -> np.ndarray:
        """A row per text, a column per pattern."""
        out = np.zeros((len(texts), len(self.patterns)), bool)
        step = max(1, STATE_WORDS // len(self.start))
        for lo in range(0, len(texts), step):
            out[lo:lo + step] = self._run(texts[lo:lo + step])
        return out

    def _run(self, texts: list[bytes]) -> np.ndarray:
        size = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-size, kind="stable")  # texts that still have bytes are in front
        flat = np.frombuffer(b"".join(texts), np.uint8)
        place = (np.cumsum(size) - size)[order]
        falling = -size[order]
        state = np.repeat(self.start[None], len(texts), axis=0)
        for j in range(int(size.max(initial=0))):
            n = int(np.searchsorted(falling, -j, side="left"))  # those longer than j
            c = flat[place[:n] + j]
            d = state[:n]
            shifted = d << np.uint64(1)
            shifted[:, 1:] |= d[:, :-1] >> np.uint64(63)
            state[:n] = (shifted & self.enter[c]) | (d & self.stay[c])
        ends = np.array(self.ends, np.int64)
        hit = (state[:, ends // 64] >> (ends % 64).astype(np.uint64)) & np.uint64(1)
        out = np.empty_like(hit, dtype=bool)
        out[order] = hit.astype(bool)
        return out


def _after_scheme(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    return F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), upper, upper.lower())


def path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def judged(pages: DataFrame, url_col: str = "url", rules: Sequence[Rule] = RULES, block: Sequence[str] = BLOCK_GLOBS) -> DataFrame:
    """``pages`` with ``_host``, ``_path``, ``_rule`` and ``_verdict``.

    The longest rule that fits decides (of equally long ones the first).  Where none fits, a URL without a host and one
    that a glob of ``block`` matches whole are blocked, and all else is allowed.  Nulls and empty tables are fine.  A URL may
    be as long as it likes: the automaton takes a byte of every URL of a batch at a time.  Raises if ``pages`` has a column of
    the result; others may have any names.
    """
    ranked = sorted(rules, key=lambda r: -len(r.name))
    globs = [g for r in ranked for g in rule_tokens(r)] + [tokens(g) for g in block]
    automaton = Automaton(globs)
    names, allow = [r.name for r in ranked], [r.allow for r in ranked]

    def verdict(urls: pd.Series) -> pd.DataFrame:
        texts = [u.encode("utf-8", "surrogatepass") for u in urls]
        hit = automaton.matches(texts)
        fits = hit[:, :2 * len(names)].reshape(len(texts), len(names), 2).any(axis=2)
        first = fits.argmax(axis=1) if names else np.zeros(len(texts), np.int64)
        some = fits.any(axis=1)
        bad = hit[:, 2 * len(names):].any(axis=1)
        rule = [names[k] if s else None for k, s in zip(first, some)]
        ok = [allow[k] if s else not b for k, s, b in zip(first, some, bad)]
        return pd.DataFrame({"rule": rule, "allow": ok})

    kind = T.StructType([T.StructField("rule", T.StringType()), T.StructField("allow", T.BooleanType())])
    out = pages.select(boxed(pages), host(F.col(url_col)).alias("_host"), path(F.col(url_col)).alias("_path"))
    out = out.withColumn("judged", F.pandas_udf(verdict, kind)(F.concat("_host", "_path")))
    allowed = F.col("judged.allow") & (F.col("judged.rule").isNotNull() | (F.col("_host") != ""))
    out = out.withColumn("_rule", F.col("judged.rule")).withColumn("_verdict", F.when(allowed, "allow").otherwise("block"))
    return unboxed(out, "_host", "_path", "_rule", "_verdict")
