"""Visually identical text with different characters, brought to one form.

Method: transitive look-alike classes by union-find over code points and strings,
representatives chosen by frequency, greedy rewriting with a multi-pattern automaton.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters of other scripts that look like Latin ones, and hyphens.
LOOKALIKES = {
    "A": "ΑАᎪ", "B": "ΒВᏴ", "C": "СϹᏟ", "D": "Ꭰ", "E": "ΕЕᎬ", "G": "ԌᏀ", "H": "ΗНᎻ", "I": "ΙІӀ", "J": "ЈᎫ", "K": "ΚКᏦ", "L": "Ꮮ",
    "M": "ΜМϺᎷ", "N": "Ν", "O": "ΟОՕ", "P": "ΡРᏢ", "Q": "Ԛ", "S": "ЅՏᏚ", "T": "ΤТᎢ", "V": "ѴᏙ", "W": "ԜᎳ", "X": "ΧХ", "Y": "ΥҮ", "Z": "ΖᏃ",
    "a": "аɑ", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һ", "i": "і", "j": "јϳ", "l": "ӏ", "n": "ո", "o": "οоօ", "p": "рρ", "q": "ԛ",
    "s": "ѕ", "u": "ս", "v": "νѵ", "w": "ԝ", "x": "х", "y": "уү", "Γ": "Г", "Δ": "∆", "Π": "П∏", "Σ": "∑", "Ω": "Ω", "μ": "µ",
    "-": "‐‑‒−⁃﹣", "'": "ʼ", ".": "․", ",": "‚", ":": "։∶", ";": ";", "!": "ǃ", "/": "∕⁄", "|": "ǀ",
}
#: Compatibility decompositions that don't change what a reader sees.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<compat>")


class Classes:
    """Union-find over strings."""

    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def top(self, s: str) -> str:
        self.up.setdefault(s, s)
        while self.up[s] != s:
            self.up[s] = self.up[self.up[s]]
            s = self.up[s]
        return s

    def join(self, a: str, b: str) -> bool:
        x, y = self.top(a), self.top(b)
        self.up[max(x, y)] = min(x, y)
        return x != y


def invisible(c: str) -> bool:
    """Code points without any ink or width."""
    return unicodedata.category(c) == "Cf" or "︀" <= c <= "️" or c in "͏ᅟᅠ឴឵ㅤﾠ"


def classes_of(chars: list[str]) -> dict[str, list[str]]:
    """{some member: all members} of the look-alike classes around the given code points."""
    of = {x: latin for latin, others in LOOKALIKES.items() for x in others}
    uf = Classes()
    todo = list(chars)
    while todo:
        c = todo.pop()
        if c in uf.up:
            continue
        near = [of[c]] if c in of else []
        if invisible(c):
            near.append("")
        elif unicodedata.category(c) in ("Zs", "Zl", "Zp") or c in "\t\n\r\v\f":
            near.append(" ")
        kind, _, rest = unicodedata.decomposition(c).rpartition("> ")
        if rest and (not kind or kind + ">" in SAME_LOOK) and " " not in near:
            near.append("".join(chr(int(x, 16)) for x in rest.split()))
            near.append(unicodedata.normalize("NFD", c) if not kind else near[-1])
        uf.top(c)
        for s in near:
            uf.join(c, s)
            todo += [x for x in s if x not in uf.up]
    # strings are alike if they are alike code point by code point: repeat until nothing joins
    moved = True
    while moved:
        moved, seen = False, {}
        for s in [s for s in uf.up if len(s) > 1]:
            form = tuple(uf.top(x) for x in s)
            moved |= uf.join(s, seen.setdefault(form, s))
            alone = [x for x in form if x != uf.top("")]
            if len(alone) == 1 and "" in uf.up:
                moved |= uf.join(s, alone[0])
    groups: dict[str, list[str]] = {}
    for s in uf.up:
        groups.setdefault(uf.top(s), []).append(s)
    return {k: sorted(v) for k, v in groups.items() if len(v) > 1}


def rewriting(groups: dict[str, list[str]], freq: dict[str, int]) -> dict[str, str]:
    """{string: representative}: the most frequent member; '' wins its class; ties go to the shortest, then smallest."""
    to = {}
    for members in groups.values():
        best = min(members, key=lambda s: (s != "", -freq.get(s, 0), len(s), s))
        to |= {s: best for s in members if s}
    return to


def rewriter(to: dict[str, str]):
    """A function that rewrites a text greedily, longest match first, until it is stable."""
    auto = ahocorasick.Automaton()
    for s, rep in to.items():
        auto.add_word(s, (len(s), rep))
    if to:
        auto.make_automaton()
    moving = {s for s, rep in to.items() if s != rep}
    touched = {c for s in moving for c in s}

    def once(text: str) -> str:
        out, at = [], 0
        for end, (n, rep) in auto.iter_long(text):
            out += (text[at : end + 1 - n], rep)
            at = end + 1
        return "".join([*out, text[at:]])

    def rewrite(text: str | None) -> str | None:
        if text is None:
            return None
        text = unicodedata.normalize("NFD", text)
        while moving and not touched.isdisjoint(text):
            new = once(text)
            if new == text:
                break
            text = new
        return unicodedata.normalize("NFC", text)

    return rewrite


def lookalike_map(texts: DataFrame, column: str) -> dict[str, str]:
    """The rewriting learned from all texts of a column.

    Collected are the distinct code points and the counts of the strings in their classes; both are
    bounded by the Unicode code space, not by the data.
    """
    counts = texts.where(F.col(column).isNotNull()).select(F.explode(F.split(column, "")).alias("c")).groupBy("c").count()
    freq = {r[0]: r[1] for r in counts.collect() if r[0]}
    groups = classes_of(sorted(freq))
    longer = sorted({s for g in groups.values() for s in g if len(s) > 1})
    if longer:
        n = [F.sum((F.length(column) - F.length(F.replace(column, F.lit(s), F.lit("")))) / len(s)).alias(f"s{i}") for i, s in enumerate(longer)]
        row = texts.agg(*n).first()
        freq |= {s: int(row[i] or 0) for i, s in enumerate(longer)}
    return rewriting(groups, freq)


def one_form(to: dict[str, str], column: Column | str) -> Column:
    """The consistent form of a text column (null stays null, '' stays '')."""

    @F.pandas_udf("string")
    def form(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        rewrite = rewriter(to)
        for s in parts:
            yield s.map(rewrite, na_action="ignore")

    return form(column)


def distinct_forms(tables: list[tuple[DataFrame, str]]) -> DataFrame:
    """(title, form) of every distinct non-null text of the given columns, in one form learned from all of them."""
    whole = tables[0][0].select(F.col(tables[0][1]).alias("title"))
    for df, c in tables[1:]:
        whole = whole.unionAll(df.select(F.col(c).alias("title")))
    to = lookalike_map(whole, "title")
    return whole.where("title IS NOT NULL").distinct().select("title", one_form(to, "title").alias("form"))


def same_look_pairs(left: DataFrame, left_id: str, right: DataFrame, right_id: str, column: str) -> DataFrame:
    """(left_id, right_id): texts that look the same but differ in their characters.

    Spaces at the ends aren't seen. Null, empty and blank texts pair with nothing; equal texts are no case;
    repeated rows each count. Forms are computed once per distinct text.
    """
    forms = distinct_forms([(left, column), (right, column)]).select("title", F.trim("form").alias("form")).where("form <> ''")
    a = left.select(F.col(left_id), F.col(column).alias("title")).join(forms, "title").withColumnRenamed("title", "ta")
    b = right.select(F.col(right_id), F.col(column).alias("title")).join(forms, "title").withColumnRenamed("title", "tb")
    return a.join(b, "form").where("ta <> tb").select(left_id, right_id)
