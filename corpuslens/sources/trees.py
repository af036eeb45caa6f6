"""Pattern scans over trees of text files."""

from __future__ import annotations

import re
from re import _constants, _parser

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def needed_literal(pattern: str) -> str:
    """The longest literal that every match of the pattern holds, or the empty string."""
    found = [""]
    parsed = _parser.parse(pattern)
    if parsed.state.flags & re.IGNORECASE:
        return ""
    for kind, value in parsed:
        if kind is _constants.LITERAL:
            found[-1] += chr(value)
        else:
            found.append("")
    return max(found, key=len)


class Scanner:
    """First match of each of many patterns in a text.

    One automaton finds which patterns' literals a text holds at all; only those patterns, and
    those without a literal, are tried."""

    def __init__(self, patterns: dict[str, str]):
        self.patterns = {n: re.compile(p) for n, p in patterns.items()}
        self.always, self.of = [], {}
        for n, p in patterns.items():
            literal = needed_literal(p)
            self.of.setdefault(literal, []).append(n) if literal else self.always.append(n)
        self.automaton = ahocorasick.Automaton()
        for literal in self.of:
            self.automaton.add_word(literal, literal)
        self.automaton.make_automaton()

    def first_matches(self, text: str) -> list[tuple[str, str, int]]:
        """(label, match, line from 1) of each pattern that has a match."""
        held = {literal for _, literal in self.automaton.iter(text)} if self.of else set()
        tried = {*self.always, *(n for literal in held for n in self.of[literal])}
        out = []
        for n, p in self.patterns.items():
            if n in tried and (m := p.search(text)):
                out.append((n, m[0], text.count("\n", 0, m.start()) + 1))
        return out


def tree_scan(spark: SparkSession, root: str, patterns: dict[str, str], extensions: list[str], exclude: list[str] = ()) -> DataFrame:
    """path (below ``root``), label, match, line: the first match of each pattern in each file of the tree.

    Files are those with one of the extensions, in no folder whose name is in ``exclude``;
    what is not UTF-8 is replaced.  An empty tree gives no rows."""
    glob = "*.{" + ",".join(e.lstrip(".") for e in extensions) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    below = F.substring_index(F.col("path"), "/" + re.sub(r"^\w*:?/*", "", root).rstrip("/") + "/", -1)
    named = files.select(below.alias("path"), "content")
    folders = F.slice(F.split("path", "/"), F.lit(1), F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    kept = named.filter(~F.arrays_overlap(folders, F.array(*map(F.lit, exclude)))) if exclude else named

    def scan(batches):
        scanner = Scanner(patterns)
        for batch in batches:
            rows = [(p, *m) for p, c in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for m in scanner.first_matches((c.as_py() or b"").decode("utf-8", "replace"))]
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int32()), strict=True)], ["path", "label", "match", "line"])

    return kept.mapInArrow(scan, "path string, label string, match string, line int")
