"""Problem 5: freely typed values mapped to a canonical list by a trie searched with a Levenshtein automaton."""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lookalike import CYRILLIC, CYRILLIC_AS, GREEK, GREEK_AS

NONE = "none"
_SHAPE = {ord(a.upper()): b.upper() for x, y in ((CYRILLIC, CYRILLIC_AS), (GREEK, GREEK_AS)) for a, b in zip(x, y, strict=True) if b != "v"}
_NUMBERED = re.compile(r"^\s*\d{1,3}\s*[.)]\s*(?=\D)")
_UNSEEN = re.compile("[\u00ad\u034f\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")
_CUTS = (re.compile("/"), re.compile(r"[()\[\]]"), re.compile("\n"), re.compile(r"[\n/()\[\],;]+"))


def normal_form(text: str) -> str:
    """One spelling for case, accents, look-alike letters, numbering, decoration and letter spacing; line breaks stay.

    Upper case first: there the letters of other scripts that can stand for a Latin one are the most, so a word comes
    out the same whichever of its letters were exchanged.
    """
    text = _UNSEEN.sub("", unicodedata.normalize("NFKC", text)).replace("_", " ")
    text = unicodedata.normalize("NFD", _NUMBERED.sub("", text).upper())
    text = "".join(c for c in text if not unicodedata.combining(c)).translate(_SHAPE)
    out = []
    for line in text.split("\n"):
        words = " ".join(line.split()).strip(" *:.#-").split(" ")
        if len(words) > 2 and all(len(w) == 1 for w in words):
            words = ["".join(words)]
        if any(words):
            out.append(" ".join(words))
    return "\n".join(out)


def allowed(length: int) -> int:
    """Edits allowed for a text of this length."""
    return 0 if length < 4 else 1 if length < 9 else 2 if length < 18 else 3


class Trie:
    """Entries of a reference list and their aliases; each path ends in the targets it stands for, with a weight."""

    def __init__(self, entries: Iterable[tuple[str, str, int]] = ()):
        self.root: dict = {}
        self.exact: dict[str, dict[str, int]] = defaultdict(dict)
        for text, target, weight in entries:
            self.add(text, target, weight)

    def add(self, text: str, target: str, weight: int = 1) -> None:
        node = self.root
        for c in text:
            node = node.setdefault(c, {})
        ends = node.setdefault("", {})
        ends[target] = ends.get(target, 0) + weight
        self.exact[text][target] = ends[target]

    def search(self, text: str, most: int) -> list[tuple[int, str, int]]:
        """(distance, target, weight) of every entry within `most` edits; swapped neighbours are one edit.

        The automaton's states are bit sets: bit i of level k says that the first i characters of `text` can have been
        read with k edits. It walks the trie and leaves each branch whose state is empty.
        """
        n = len(text)
        where: dict[str, int] = defaultdict(int)
        for i, c in enumerate(text):
            where[c] |= 1 << i
        full = (1 << (n + 1)) - 1
        start = [(1 << (k + 1)) - 1 & full for k in range(most + 1)]
        found: list[tuple[int, str, int]] = []
        stack = [(self.root, start, None, "")]
        while stack:
            node, state, before, last = stack.pop()
            for c, child in node.items():
                if c == "":
                    for k, s in enumerate(state):
                        if s >> n & 1:
                            found += [(k, t, w) for t, w in child.items()]
                            break
                    continue
                m = where.get(c, 0)
                after = [(state[0] & m) << 1]
                for k in range(1, most + 1):
                    s = (state[k] & m) << 1 | state[k - 1] | state[k - 1] << 1 | after[k - 1] << 1
                    if before is not None:
                        s |= ((before[k - 1] & m) << 1 & where.get(last, 0)) << 1
                    after.append(s & full)
                if any(after):
                    stack.append((child, after, state, c))
        return sorted(found)

    def under(self, prefix: str) -> dict[str, int]:
        """Targets of all entries that begin with `prefix`, with their summed weights."""
        node = self.root
        for c in prefix:
            node = node.get(c)
            if node is None:
                return {}
        out: dict[str, int] = defaultdict(int)
        stack = [node]
        while stack:
            for c, child in stack.pop().items():
                if c == "":
                    for t, w in child.items():
                        out[t] += w
                else:
                    stack.append(child)
        return out


class Resolver:
    """Normalised texts to targets, or NONE; remembers what it resolved.

    paths: the aliases with a path of their own in the trie, where another Resolver of the same aliases has chosen them.
    """

    def __init__(self, titles: list[tuple[str, str]], aliases: list[tuple[str, str, int]] = (), paths: set[str] | None = None):
        self.exact: dict[str, str] = {}
        self.paths: set[str] = set()
        best: dict[str, int] = {}
        trie = Trie()
        for text, target in titles:
            self.exact[normal_form(text)] = target
            trie.add(normal_form(text), target, 1000000)
        for text, target, weight in sorted(aliases, key=lambda a: (-a[2], a[0], a[1])):
            if text in best:
                continue
            best[text] = weight
            self.exact.setdefault(text, target)
            if paths is None:
                near = trie.search(text, min(1, allowed(len(text))))
                own = not any(t == target and w >= 5 * weight for _, t, w in near)  # a misspelling needs no path of its own
            else:
                own = text in paths
            if own:
                self.paths.add(text)
                trie.add(text, target, weight)
        self.trie = trie
        self.memo: dict[str, tuple[str, int, str]] = {}

    def near(self, text: str) -> tuple[str, int] | None:
        """The target of the closest entry, the weightiest of equals."""
        found = self.trie.search(text, allowed(len(text)))
        if not found:
            return None
        sums: dict[str, int] = defaultdict(int)
        for d, t, w in found:
            if d == found[0][0]:
                sums[t] += w
        return max(sorted(sums), key=sums.get), found[0][0]

    def resolve(self, text: str) -> tuple[str, int, str]:
        """(target, edits, how): how is exact, parts, near, cut off, or unmatched."""
        got = self.memo.get(text)
        if got is None:
            if len(self.memo) > 1 << 18:
                self.memo.clear()
            got = self.memo[text] = self._resolve(text)
        return got

    def _resolve(self, text: str) -> tuple[str, int, str]:
        flat = " ".join(text.split())
        if flat in self.exact:
            return self.exact[flat], 0, "exact"
        for find, how in ((self._exact, "parts"), (self.near, "near")):
            if how == "near" and (got := self.near(flat)):
                return (*got, "near")
            cuts = [[p for p in (" ".join(x.split()).strip(" *:.#-") for x in cut_at.split(text)) if p] for cut_at in _CUTS]
            cuts = [c for c in cuts if len(c) > 1]
            words = flat.split(" ")
            for halves in cuts + [[" ".join(words[:i]), " ".join(words[i:])] for i in range(1, len(words))]:
                hits = [find(h) for h in halves]
                if all(hits) and len({t for t, _ in hits}) == 1:
                    return hits[0][0], sum(d for _, d in hits), how
            for pieces in cuts:
                hits = [h for h in map(find, pieces) if h]
                fields = [h for h in hits if h[0] != NONE] or hits
                if fields:
                    return (*min(fields, key=lambda h: h[1]), how)
        if len(flat) >= 5:
            below = self.trie.under(flat)
            total = sum(below.values())
            if below and max(below.values()) >= 0.6 * total:
                return max(sorted(below), key=below.get), 0, "cut off"
        return NONE, 0, "unmatched"

    def _exact(self, text: str) -> tuple[str, int] | None:
        return (self.exact[text], 0) if text in self.exact else None


def cells(sheets: DataFrame, id_col: str, text_col: str, map_col: str, separator: str) -> DataFrame:
    """(id, col_no, cell, vote, voted): each cell of each row with what earlier work says of it, cut and looked up by Catalyst."""
    cut_at = F.split(text_col, re.escape(separator).replace("\\ ", " "))
    long = sheets.select(id_col, map_col, F.posexplode(cut_at).alias("col_no", "cell"))
    return long.select(id_col, "col_no", "cell", F.try_element_at(map_col, F.col("col_no")).alias("vote"), F.coalesce(F.size(map_col) > 0, F.lit(False)).alias("voted"))


def learn_aliases(sheets: DataFrame, titles: list[tuple[str, str]], id_col: str = "sheet_id", text_col: str = "header_text", map_col: str = "mapping", separator: str = " | ") -> list[tuple[str, str, int]]:
    """(form, target, support): all aliases of the canonical entries that earlier, partly wrong work agrees on.

    Every cell of every sheet with such work votes, a cell of one sheet only once however often that was delivered; equal
    cells with equal votes are counted before any is looked at, and votes that are themselves loosely written are resolved against the titles. A form stands for a target if it has two
    votes for it, 70 % of the votes for any agree and at most 70 % of its cells have none; for NONE if it comes 5 times
    and at most an eighth of its cells have a vote. However rare, each such form counts: they come to the driver and
    go with every task, so both need memory for the distinct forms that are agreed on, not for the cells.
    """
    keys = sorted({t for _, t in titles}) or [NONE]  # without entries nothing can be meant

    def run(frames):
        forms: dict[str, str] = {}
        loose = Resolver([*titles, *((k.replace("_", " "), k) for k in keys)])
        for pdf in frames:
            out: dict[tuple[str, str], int] = defaultdict(int)
            for cell, vote, n in zip(pdf.cell, pdf.vote, pdf.n):
                form = _form(cell, forms)
                if form:
                    target = NONE if vote is None else vote if vote in keys else loose.resolve(normal_form(vote))[0] if vote else NONE
                    out[" ".join(form.split()), target] += n
            yield pd.DataFrame([(f, t, n) for (f, t), n in out.items()], columns=["form", "target", "n"])

    counted = cells(sheets, id_col, text_col, map_col, separator).where("voted").groupBy("cell", "vote").agg(F.when(F.min(id_col) == F.max(id_col), F.lit(1).cast("bigint")).otherwise(F.count("*")).alias("n"))
    votes = counted.mapInPandas(run, "form string, target string, n bigint")
    forms = votes.groupBy("form").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("target") != NONE, F.col("n"))).alias("voted"), *(F.sum(F.when(F.col("target") == k, F.col("n"))).alias(f"_{k}") for k in keys))
    tops = F.array_max(F.array(*(F.struct(F.coalesce(F.col(f"_{k}"), F.lit(0)).alias("n"), F.lit(k).alias("k")) for k in keys)))
    forms = forms.select("form", "total", F.coalesce("voted", F.lit(0)).alias("voted"), tops.alias("top"))
    agreed = (F.col("top.n") >= 2) & (F.col("top.n") >= 0.7 * F.col("voted")) & (F.col("voted") >= 0.3 * F.col("total"))
    nothing = (F.col("total") >= 5) & (F.col("voted") <= F.col("total") / 8)
    forms = forms.select("form", F.when(agreed, F.col("top.k")).when(nothing, F.lit(NONE)).alias("target"), "total")
    return [tuple(r) for r in forms.where("target is not null").select("form", "target", "total").collect()]


def _form(cell: str, forms: dict[str, str]) -> str:
    got = forms.get(cell)
    if got is None:
        if len(forms) > 1 << 18:
            forms.clear()
        got = forms[cell] = normal_form(cell)
    return got


def map_values(sheets: DataFrame, titles: list[tuple[str, str]], aliases: list[tuple[str, str, int]], id_col: str = "sheet_id", text_col: str = "header_text", map_col: str = "mapping", separator: str = " | ") -> DataFrame:
    """(id, col_no, cell, field_key, edits, how) for every cell that isn't blank; `none` where no entry is meant.

    Arrow batches: each distinct cell of a batch is resolved once and taken by index. Titles and all aliases go with the
    task, and which of them have a path in the trie, which is found out once. Null and empty texts give no row; a text of separators
    only has blank cells only. A repeated row gives its cells again.
    """
    shared = sheets.sparkSession.sparkContext.broadcast((aliases, Resolver(titles, aliases).paths))
    kind = sheets.schema[id_col].dataType.simpleString()
    out = f"`{id_col}` {kind}, col_no int, cell string, field_key string, edits int, how string"

    def run(batches):
        forms: dict[str, str] = {}
        resolver = Resolver(titles, *shared.value)
        for batch in batches:
            coded = pa.array(batch.column(2)).dictionary_encode()
            values = coded.dictionary.to_pylist()
            made = []
            for cell in values:
                form = _form(cell, forms)
                blank = not form and (not cell or cell.isspace())
                made.append((None, None, None) if blank else resolver.resolve(form))
            columns = [pa.array([m[i] for m in made], t).take(coded.indices) for i, t in enumerate((pa.string(), pa.int32(), pa.string()))]
            rows = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *columns], [id_col, "col_no", "cell", "field_key", "edits", "how"])
            yield rows.filter(pc.is_valid(rows.column(3)))

    return cells(sheets, id_col, text_col, map_col, separator).where("cell is not null").select(id_col, "col_no", "cell").mapInArrow(run, out)
