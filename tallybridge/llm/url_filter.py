"""URL filters: a trie over reversed host labels and path segments, broadcast.

Rules are (verdict, host, path). A rule fits a host and all its subdomains where the url's path
starts with the rule's path. The trie is walked along the host's labels from the last one, and at
each label along the path's segments; the deepest rule wins: more host labels first, then the
longer path. Of equal rules that disagree, ``block`` wins.

The rules are a parameter, not data: their number is bounded by ``MOST_RULES``, which is checked,
and the work per url is bounded by its own length, not by the number of rules.

Defined results: a null url, or one without ``://``, has an empty host and an empty path and is blocked,
as nothing can be fetched from it; any other url that no rule fits is allowed. Other columns stay, and
give way to an added column of the same name; repeated rows are judged each.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import add_columns, without

MOST_RULES = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Paths below a host node: (segments before the last '/', what follows it) is one rule.
_RULES, _PATHS = "/rules", "/paths"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z in lower case, and the path of a url; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def build_trie(rules: Iterable[tuple[str, str, str]]) -> dict:
    """Nested dictionaries: host labels from the last one, then whole path segments."""
    trie: dict = {}
    for number, (verdict, host, path) in enumerate(rules):
        if number >= MOST_RULES:
            raise ValueError(f"more than {MOST_RULES} rules")
        if verdict not in ("allow", "block"):
            raise ValueError(f"no such verdict: {verdict}")
        node = trie
        for label in reversed(host.translate(str.maketrans(UPPER, LOWER)).split(".")):
            node = node.setdefault(label, {})
        node = node.setdefault(_PATHS, {})
        *segments, last = path.split("/")
        for segment in segments:
            node = node.setdefault(segment, {})
        ends = node.setdefault(_RULES, {})
        if ends.get(last, ("", ""))[1] != "block":
            ends[last] = (f"{host}{path}", verdict)
    return trie


def _below(paths: dict, path: str) -> tuple[str, str] | None:
    """The rule with the longest path that ``path`` starts with."""
    best, node = None, paths
    for segment in path.split("/"):
        ends = node.get(_RULES)
        if ends:
            # a rule may end inside a segment, so all beginnings of it are asked, longest first
            best = next((ends[segment[:n]] for n in range(len(segment), -1, -1) if segment[:n] in ends), best)
        node = node.get(segment)
        if node is None:
            break
    return best


def longest_match(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule that fits, or None."""
    best, node = None, trie
    for label in reversed(host.split(".")):
        node = node.get(label)
        if node is None:
            break
        best = _below(node.get(_PATHS, {}), path) or best
    return best


def judge_urls(
    pages: DataFrame,
    rules: list[tuple[str, str, str]],
    url: str = "url",
    keep: list[str] | None = None,
) -> DataFrame:
    """``host``, ``path``, ``rule`` and ``verdict`` beside the columns of ``pages``."""
    trie = pages.sparkSession.sparkContext.broadcast(build_trie(rules))
    names = ["host", "path", "rule", "verdict"]
    kept = without(pages.select([f"`{c}`" for c in (keep or pages.columns)]), names).columns
    host, path = host_and_path(pages[f"`{url}`"])
    parsed = pages.select(*[pages[f"`{c}`"] for c in kept], host.alias("host"), path.alias("path"))

    def start():
        root = trie.value

        def judge(host: str, path: str) -> tuple[str | None, str]:
            found = longest_match(root, host, path)
            return found or (None, "allow" if host else "block")

        return judge

    added = T.StructType(
        [T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())]
    )
    return add_columns(parsed, ["host", "path"], added, start)
