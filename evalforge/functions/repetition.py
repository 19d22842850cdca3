"""where unfenced generated text starts to repeat itself, as array expressions.

The kept text ends before the first line i (from 0) that satisfies one of:

* repeat: i > 50 and the line's signature stands on an earlier line;
* fence: i > 30, the line opens with a fence, three more lines follow, and a
  signature of an earlier line occurs in those three;
* burst: i > 200, the line holds a fence, five more lines follow, and these six
  lines hold more than two definitions.

Signatures are sorted with their lines once; the first entry of a name is where
it was introduced, every later one a repeat.  No line is looked at in order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .extract import first_fenced_block, py_strip
from .unicode import spelled

# Fixed values (must equal the reference's).
REPEAT_AFTER, FENCE_AFTER, BURST_AFTER = 50, 30, 200
FENCE_LOOKAHEAD, BURST_LINES, BURST_DEFINITIONS = 3, 6, 2
NAME_MARKERS = ("template", "class ", "struct ")
NAME_PATTERN = spelled(r"(?:class|struct|template)\s+(\w+)")
HEAD_PREFIXES = ("int main", "void ", "bool ", "T ")
DEFINITION_PATTERN = r"(?:class|struct|template|int main)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _signature(line: Column) -> Column:
    named, head = F.lit(False), F.lit(False)
    for m in NAME_MARKERS:
        named = named | line.contains(m)
    for p in HEAD_PREFIXES:
        head = head | line.startswith(p)
    return (F.when(named, F.when(line.rlike(NAME_PATTERN), F.regexp_extract(line, NAME_PATTERN, 1)))
            .when(head, F.substring_index(line, "(", 1)))


def _cut_at(lines: Column) -> Column:
    """Number of lines kept."""
    n = F.size(lines)

    def of_lines(bare: Column) -> Column:
        signed = F.array_sort(F.filter(
            F.transform(bare, lambda s, i: F.struct(_signature(s).alias("name"), i.alias("at"))),
            lambda x: x["name"].isNotNull()))

        def of_signed(sig: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(sig, k - 1)["name"] == x["name"], F.lit(False))
            repeats = F.filter(sig, lambda x, k: same(x, k) & (x["at"] > REPEAT_AFTER))
            fences = F.filter(F.transform(bare, lambda s, i: F.struct(i.alias("at"), s.startswith("```").alias("opens"),
                                                                       s.contains("```").alias("holds"))),
                              lambda x: x["holds"])

            def following(at: Column, first: int, count: int) -> Column:
                return F.array_join(F.slice(lines, at + 1 + first, count), "\n")
            known = F.filter(fences, lambda x: x["opens"] & (x["at"] > FENCE_AFTER) & (x["at"] + FENCE_LOOKAHEAD < n) & let(
                following(x["at"], 1, FENCE_LOOKAHEAD),
                lambda ahead: F.exists(sig, lambda g: (g["at"] < x["at"]) & ahead.contains(g["name"]))))
            bursts = F.filter(fences, lambda x: (x["at"] > BURST_AFTER) & (x["at"] + BURST_LINES - 1 < n) & (
                F.regexp_count(following(x["at"], 0, BURST_LINES), F.lit(DEFINITION_PATTERN)) > BURST_DEFINITIONS))
            first = lambda xs: F.array_min(F.transform(xs, lambda x: x["at"]))
            return F.least(first(repeats), first(known), first(bursts), n)
        return let(signed, of_signed)
    return let(F.transform(lines, py_strip), of_lines)


def repetition_cut(text: Column) -> Column:
    """the lines before the first repetition, stripped; empty and NULL texts as they are."""
    cut = let(F.split(text, "\n", -1), lambda lines: F.array_join(F.slice(lines, 1, _cut_at(lines)), "\n"))
    return F.when(text.isNull() | (text == ""), text).otherwise(py_strip(cut))


def first_code_block(text: Column) -> Column:
    """F23 complete: through the first closed fence if there is one, else F24."""
    return F.when(text.isNull() | (text == ""), text).otherwise(
        F.coalesce(first_fenced_block(text), repetition_cut(text)))
