"""Problem 8: text garbled by a wrong decoding, found and restored by character n-gram models over decode chains."""

from __future__ import annotations

import codecs
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Encodings a text may wrongly have been read in, and those it may really have been written in.
READ_AS = ("latin-1", "cp1252", "cp1250", "cp1251", "cp1254", "cp437", "cp866", "mac_roman", "koi8-r", "gb18030")
WRITTEN_IN = ("utf-8", "cp1251", "koi8-r", "cp866", "gb18030", "cp1252", "cp1250", "cp1254")
DEPTH = 3
#: Size of the hashed table of pair counts: 16 MB, and the same for every corpus.
SLOT_BITS = 22
#: Taken off every count of a pair, so that one seen once weighs next to nothing.
DISCOUNT = 0.9
_TOKENS = re.compile(r"[^ \t]+")
_LOST = "�"
#: What the best of all single-byte readings gains by being the best of so many.
_CHANCE = math.log(len(READ_AS) * (len(WRITTEN_IN) - 1))


def _table(name: str) -> dict[int, int]:
    """Character to byte; bytes that the encoding leaves undefined stand for the control of the same number."""
    return {ord(bytes((b,)).decode(name, "ignore") or chr(b)): b for b in range(256)}


_TABLES = {n: _table(n) for n in READ_AS if n != "gb18030"}


def _bytes(text: str, name: str) -> bytes | None:
    try:
        if name == "gb18030":
            return text.replace(_LOST, "").encode("gbk")
        return codecs.charmap_encode(text, "strict", _TABLES[name])[0]
    except UnicodeEncodeError:
        return None


def _reread(data: bytes, name: str) -> str | None:
    """The bytes in another encoding; in UTF-8 a quarter of the characters may be broken, as where bytes were lost."""
    try:
        return data.decode(name)
    except UnicodeDecodeError:
        if name != "utf-8":
            return None
    text = data.decode("utf-8", "replace")
    return text if len(text) >= 4 and text.count(_LOST) * 4 <= len(text) else None


def _mix(pairs: np.ndarray) -> np.ndarray:
    """Slot of each pair of code points in the table of counts."""
    x = pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


class CharModel:
    """Interpolated character bigrams over hashed counts; an unseen character costs what a rare one of a million would.

    The counts of all pairs stand in a table of fixed size, those of single characters beside it, so that no pair of
    the corpus is left out and the model never outgrows its bound, whatever the corpus' size.
    """

    def __init__(self, slots: np.ndarray | dict[tuple[str, str], int], singles: np.ndarray | dict[str, int]):
        if isinstance(slots, dict):  # plain counts of pairs and of characters
            pairs, chars = slots, singles
            slots, singles = np.zeros(1 << SLOT_BITS, np.float32), np.zeros(0x110000, np.float32)
            np.add.at(slots, _mix(np.array([ord(a) << 21 | ord(b) for a, b in pairs], np.int64)), list(pairs.values()))
            singles[[ord(c) for c in chars]] = list(chars.values())
        self.slots, self.singles = slots, singles
        total = float(singles.sum()) or 1.0
        self.alone = 4 * (singles + 0.1) / (total + 1e5)
        self.memo: dict[str, float] = {}

    def scores(self, tokens: list[str]) -> list[float]:
        """Natural log of each token's probability, from space to space; all tokens at once."""
        fresh = list({t for t in tokens if t not in self.memo})
        if len(self.memo) > 1 << 18:
            self.memo.clear()
            fresh = list(set(tokens))
        if fresh:
            text = " " + " ".join(fresh) + " "
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            before, after = points[:-1], points[1:]
            logs = np.log((self.slots[_mix(before << 21 | after)] + self.alone[after]) / (self.singles[before] + 4))
            starts = np.cumsum([0, *(len(t) + 1 for t in fresh)])[:-1]
            self.memo.update(zip(fresh, np.add.reduceat(logs, starts).tolist()))
        return [self.memo[t] for t in tokens]


class Detector:
    """Scores every chain of readings on the tokens of each line; the likeliest run of tokens that gains more than `margin`.

    A chain goes on after a step to UTF-8, which few tokens allow, unless it clearly loses. Other steps gain nothing by themselves where
    two misreadings follow one another; they are followed where the token is less likely for its length than
    `unlikely`, a level that next to no clean token falls below.
    """

    def __init__(self, model: CharModel, margin: float = 8.0, unlikely: float = -math.inf):
        self.model, self.margin, self.unlikely = model, margin, unlikely
        self.memo: dict[str, dict[tuple, tuple[float, str]]] = {}

    def readings(self, text: str) -> dict[tuple, str]:
        """(read as, written in) to the text read anew; encodings that give the same bytes share the decoding."""
        out: dict[tuple, str] = {}
        decoded: dict[bytes, list[tuple[str, str]]] = {}
        lost = _LOST in text
        for wrong in READ_AS:
            data = _bytes(text, wrong)
            if data is None:
                continue
            found = decoded.get(data)
            if found is None:
                found = decoded[data] = [(right, new) for right in (WRITTEN_IN[:1] if lost else WRITTEN_IN) if (new := _reread(data, right)) and new != text]
            for right, new in found:
                if right != wrong:
                    out[wrong, right] = new
        return out

    def learn(self, tokens: list[str]) -> None:
        """Scores the chains of all given tokens together."""
        if len(self.memo) > 1 << 16:
            self.memo.clear()
        fresh = [t for t in dict.fromkeys(tokens) if t not in self.memo]
        base = dict(zip(fresh, self.model.scores(fresh)))
        level = [(t, (), t) for t in fresh]
        for t in fresh:
            self.memo[t] = {}
        for _ in range(DEPTH):
            known: dict[str, dict[tuple, str]] = {}
            for _, _, text in level:
                if text not in known:
                    known[text] = self.readings(text)
            every = list({new for r in known.values() for new in r.values()})
            score = dict(zip(every, self.model.scores(every)))
            following = []
            for token, chain, text in level:
                got = self.memo[token]
                doubtful = base[token] < self.unlikely * (len(token) + 1)
                for (wrong, right), new in known[text].items():
                    gain = score[new] - base[token]
                    if gain <= -4.0 and not (doubtful and right != "utf-8"):
                        continue
                    if right != "utf-8" and len(token) < 3:
                        gain = min(gain, 0.5)  # a sign or two prove nothing where each byte is a character
                    longer = (*chain, (wrong, right))
                    if gain > -4.0:  # a worse one ends a run: the token stands between two garbled ones, each restored by itself
                        got[longer] = (gain, new)
                    if not new.isascii() and (gain > -4.0 if right == "utf-8" else doubtful and not chain and gain > -2.0 * len(token)):
                        following.append((token, longer, new))
            level = following
            if not level:
                break

    def chains(self, token: str) -> dict[tuple, tuple[float, str]]:
        """Chain to (gain in log likelihood, text) of each other reading of a token."""
        if token not in self.memo:
            self.learn([token])
        return self.memo[token]

    def gains(self, token: str, more: float = 2.0) -> bool:
        """Whether another reading of the token is likelier by more than `more` nats."""
        return any(g > more for g, _ in self.chains(token).values())

    def line(self, line: str) -> tuple[float, str]:
        """(best gain, line with its likeliest garbled run restored)."""
        options = [self.chains(t) if not t.isascii() else None for t in _TOKENS.findall(line)]
        hopeful = {c for o in options if o for c, (g, _) in o.items() if g > 0}
        if not hopeful:
            return 0.0, line
        spans = [(m.start(), m.end(), m[0]) for m in _TOKENS.finditer(line)]
        best, found = 0.0, None
        for chain in hopeful:
            # bytes that happen to be UTF-8 prove something; of the many single-byte readings the best gains by chance
            odds = 0.0 if all(right == "utf-8" for _, right in chain) else _CHANCE
            run, start = 0.0, 0
            for i, o in enumerate(options):
                if o is None:
                    gain = 0.0
                else:
                    gain = o[chain][0] if chain in o else -math.inf
                if run + gain <= 0:
                    run, start = 0.0, i + 1
                    continue
                run += gain
                if run - odds > best + 1e-9 or (run - odds == best and found and len(chain) < len(found[0])):
                    best, found = run - odds, (chain, start, i)
        if not found or best < self.margin:
            return best, line
        chain, start, end = found
        out, at = [], 0
        for i in range(start, end + 1):
            a, b, token = spans[i]
            out += [line[at:a], options[i][chain][1] if options[i] is not None else token]
            at = b
        return best, "".join(out) + line[at:]

    def repair(self, text: str) -> tuple[bool, str, float]:
        """(garbled, text as far as it can be restored, largest gain); lost characters mark a text that can't be restored."""
        if text.isascii():
            return False, text, 0.0
        garbled, most, lines = _LOST in text, 0.0, text.split("\n")
        for i, line in enumerate(lines):
            if line.isascii():
                continue
            seen = {line}
            while True:  # a line may hold any number of runs
                gain, new = self.line(line)
                most = max(most, gain)
                if gain < self.margin or new in seen:
                    break
                seen.add(new)
                garbled, line = True, new
            lines[i] = line
        return garbled, "\n".join(lines), most


def _looks_clean(text: str, seen: dict[str, bool]) -> bool:
    """Whether no token reads as UTF-8 when its characters are taken for bytes, and none mixes case or scripts oddly."""
    if text.isascii():
        return True
    if _LOST in text or re.search("[\x80-\x9f]|[À-ÿ]{4}|[а-яё][А-ЯЁ]{2}|[─-▟][^\\W\\d_]|[^\\W\\d_][─-▟]", text):
        return False
    for token in text.split():
        ok = seen.get(token)
        if ok is None:
            ok = token.isascii()
            if not ok:
                ok = True
                for wrong in READ_AS:
                    data = _bytes(token, wrong)
                    if data is not None and not data.isascii():
                        try:
                            other = data.decode("utf-8")
                        except UnicodeDecodeError:
                            continue
                        if wrong not in ("cp866", "koi8-r", "cp1251", "gb18030") or sum(c > "\x7f" for c in other) > 1:
                            ok = False
                            break
            if len(seen) > 1 << 17:
                seen.clear()
            seen[token] = ok
        if not ok:
            return False
    return True


def _held_out(text: str) -> Column:
    """A tenth of all texts, by the hash of the text, so that copies of one lie on one side."""
    return F.pmod(F.xxhash64(F.col(text)), F.lit(10)) == 0


def _counted(docs: DataFrame, text_col: str, shared) -> CharModel:
    """The model of the texts that look clean; with a first model, of those in which it finds no better reading of any token."""

    def run(frames) -> Iterator[pd.DataFrame]:
        seen: dict[str, bool] = {}
        judge = Detector(CharModel(*shared.value)) if shared else None
        for pdf in frames:
            clean = [t for t in pdf.iloc[:, 0] if isinstance(t, str) and _looks_clean(t, seen)]
            if judge:
                judge.learn([w for t in clean if not t.isascii() for w in t.split() if not w.isascii()])
                clean = [t for t in clean if t.isascii() or not any(judge.gains(w) for w in t.split() if not w.isascii())]
            if not clean:
                continue
            text = "".join(" " + t.replace("\n", " ") + " " for t in clean)
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            slot, n = np.unique(_mix(points[:-1] << 21 | points[1:]), return_counts=True)
            char, m = np.unique(points[1:], return_counts=True)
            yield pd.DataFrame({"key": np.concatenate([slot, -1 - char]), "n": np.concatenate([n, m])})

    counts = docs.where(~_held_out(text_col)).select(text_col).mapInPandas(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    slots, singles = np.zeros(1 << SLOT_BITS, np.float32), np.zeros(0x110000, np.float32)
    key, n = counts.key.to_numpy(np.int64), counts.n.to_numpy(np.float32)
    slots[key[key >= 0]] = np.maximum(n[key >= 0] - DISCOUNT, 0)
    singles[-1 - key[key < 0]] = n[key < 0]
    return CharModel(slots, singles)


def train(docs: DataFrame, text_col: str = "text") -> CharModel:
    """The model from all clean texts that aren't held out, counted over the whole corpus in two passes.

    The first counts the texts that look clean by their characters; some garbled ones are among them, and their signs
    would seem usual. The second leaves out texts in which the first model prefers another reading of a token. The hashed
    counts of all pairs come to the driver, 2**SLOT_BITS at most, and the characters, as many as Unicode has at most.
    Copies of a text count as often as they come.
    """
    first = _counted(docs, text_col, None)
    return _counted(docs, text_col, docs.sparkSession.sparkContext.broadcast((first.slots, first.singles)))


def garbled_line(line: str, seed: int) -> str | None:
    """The line with a run of tokens around one that isn't plain ASCII read in a wrong encoding; None if that changes nothing."""
    spans = [m.span() for m in _TOKENS.finditer(line)]
    odd = [i for i, (a, b) in enumerate(spans) if not line[a:b].isascii()]
    if not odd:
        return None
    first = odd[seed % len(odd)]
    last = min(len(spans) - 1, first + seed // 7 % 4)
    a, b = spans[first][0], spans[last][1]
    wrong = READ_AS[seed // 31 % 6]
    try:
        new = line[a:b].encode("utf-8").decode("latin-1")
        if wrong != "latin-1":
            new = "".join({v: chr(k) for k, v in _TABLES[wrong].items()}[c] for c in line[a:b].encode("utf-8"))
    except (UnicodeError, KeyError):
        return None
    return line[:a] + new + line[b:] if new != line[a:b] and "\n" not in new and " " not in new.strip() else None


#: Margins to choose from.
_STEPS = np.arange(1.0, 20.25, 0.25)


def _odd_tokens(lines: list[str]) -> list[str]:
    return [t for line in lines for t in line.split() if not t.isascii()]


def _garbled(lines: list[str]) -> list[tuple[str, str]]:
    """Lines with what garbling made of them, the same for a line wherever it lies."""
    made = ((line, garbled_line(line, zlib.crc32(line.encode("utf-8", "surrogatepass")))) for line in lines)
    return [(line, bad) for line, bad in made if bad]


def validated(model: CharModel, texts: DataFrame, measure: bool = True) -> tuple[Detector, dict[str, float]]:
    """The detector with margin and level from all texts kept out of training, and what was measured on them.

    The level is the one that one clean token in a thousand falls below. The margin is where the fewest lines are told
    wrongly: clean lines whose best reading gains more, and lines of the same texts, garbled here, that gain less. Lines
    that are really garbled already gain at any margin in reach and don't move it. Each distinct token and line counts
    once; they are scored where they lie, and only counts for each margin come to the driver. measure: the figures too.
    """
    shared = texts.sparkSession.sparkContext.broadcast((model.slots, model.singles))

    def parts(frames) -> Iterator[pd.DataFrame]:
        seen: dict[str, bool] = {}
        for pdf in frames:
            clean = [t for t in pdf.iloc[:, 0] if isinstance(t, str) and not t.isascii() and _looks_clean(t, seen)]
            lines = {line for t in clean for line in t.split("\n") if not line.isascii()}
            tokens = set(_odd_tokens(clean))
            yield pd.DataFrame({"line": [True] * len(lines) + [False] * len(tokens), "part": [*lines, *tokens]})

    def rates(frames) -> Iterator[pd.DataFrame]:
        own = CharModel(*shared.value)
        for pdf in frames:
            tokens = pdf.part.tolist()
            yield pd.DataFrame({"rate": [x / (len(t) + 1) for t, x in zip(tokens, own.scores(tokens))]})

    both = texts.mapInPandas(parts, "line boolean, part string").distinct().persist(StorageLevel.MEMORY_AND_DISK)
    lines, rated = both.where("line").select("part"), both.where("not line").select("part").mapInPandas(rates, "rate double")
    lowest = rated.count() // 1000 + 1
    level = rated.orderBy("rate").limit(lowest).agg(F.max("rate")).first()[0]
    level = -math.inf if level is None else level

    def gains(frames) -> Iterator[pd.DataFrame]:
        own = Detector(CharModel(*shared.value), math.inf, level)
        for pdf in frames:
            clean = pdf.part.tolist()
            bad = [b for _, b in _garbled(clean)]
            own.learn(_odd_tokens(clean + bad))
            good, found = (np.array([own.line(x)[0] for x in some]) for some in (clean, bad))
            yield pd.DataFrame({"step": np.arange(len(_STEPS)), "lines": len(clean), "garbled": len(bad), "above": [(good > m).sum() for m in _STEPS], "missed": [(found <= m).sum() for m in _STEPS]})

    def restored(frames) -> Iterator[pd.DataFrame]:
        own = Detector(CharModel(*shared.value), margin, level)
        for pdf in frames:
            made = _garbled(pdf.part.tolist())
            own.learn(_odd_tokens([b for _, b in made]))
            yield pd.DataFrame({"n": [sum(own.repair(bad)[1] == line for line, bad in made)]})

    names = ["lines", "garbled", "above", "missed"]
    told = lines.mapInPandas(gains, "step int, lines bigint, garbled bigint, above bigint, missed bigint").groupBy("step").agg(*(F.sum(c).alias(c) for c in names)).orderBy("step").toPandas()
    if not len(told) or told.lines[0] < 20:
        both.unpersist()
        return Detector(model, 8.0, level), {}
    wrong = told.above + told.missed
    margin = float(np.median(_STEPS[(wrong == wrong.min()).to_numpy()]))
    # the margin may lie between two steps of the fewest: the counts are those of the step below
    at = told.iloc[int(np.searchsorted(_STEPS, margin, "right")) - 1]
    figures = {c: int(at[c]) for c in names} | {"margin": margin, "level": level}
    if measure:
        figures["restored"] = lines.mapInPandas(restored, "n bigint").agg(F.sum("n")).first()[0]
    both.unpersist()
    return Detector(model, margin, level), figures


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Detector:
    """A detector for the corpus: model from all clean texts but a tenth, margin from all clean ones of that tenth."""
    return fit_measured(docs, id_col, text_col, False)[0]


def fit_measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", measure: bool = True) -> tuple[Detector, dict[str, float]]:
    """As fit, with the figures measured on the held-out texts, each of which counts once."""
    return validated(train(docs, text_col), docs.where(_held_out(text_col)).select(text_col).distinct(), measure)


def repair_corpus(docs: DataFrame, detector: Detector, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, garbled, restored, gain) of every row; whole texts, map-only.

    A null or empty text isn't garbled and comes back as it is. Lost characters (U+FFFD) make a text garbled; what stands
    beside them is restored where a chain still fits.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((detector.model.slots, detector.model.singles, detector.margin, detector.unlikely))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(frames):
        slots, singles, margin, unlikely = shared.value
        own = Detector(CharModel(slots, singles), margin, unlikely)
        for pdf in frames:
            out = []
            own.learn([t for text in pdf.iloc[:, 1] if isinstance(text, str) and not text.isascii() for t in text.split() if not t.isascii()])
            for doc, text in zip(pdf.iloc[:, 0], pdf.iloc[:, 1]):
                out.append((doc, *own.repair(text)) if isinstance(text, str) else (doc, False, text, 0.0))
            yield pd.DataFrame(out, columns=[id_col, "garbled", "restored", "gain"])

    return docs.select(id_col, text_col).mapInPandas(run, f"`{id_col}` {kind}, garbled boolean, restored string, gain double")
