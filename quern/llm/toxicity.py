"""Toxicity of deobfuscated text (operator 4).

The channel model: a writer of words under a character language model swaps letters for look-alike
signs, stretches them and puts spaces or marks between them. Stretches of text that such a channel
may have produced (signs among letters, letters set apart, runs of one letter) become lattices of
letters, which a Viterbi search under the character model decodes; all other text has one path, itself.
The restored text is scored by the evidence of its words and word beginnings, learned from labelled
texts that were restored in the same way. In letters that stand apart the search may end a word
before any of them.

Defined cases: null and empty texts have no evidence and get the base score; labels that are null or
belong to no document don't count; of several labels of one document the largest counts; without
training rows of both classes every score is the base share; a null doc_id counts as '' for the
remainder; repeated rows are scored alike; texts of any length are restored whole; other columns are
ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, store, table
from .labelled import remainder, training

# fixed values: signs by the letters they may stand for
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "*": "aeiou", "#": "aeiou", "¡": "i", "§": "s", "¢": "c", "¥": "y", "ø": "o", "µ": "u", "×": "x"}
#: Marks that may stand between letters, and plain punctuation around a word.
GAPS = "._-*~^'`·,|/\\"
AROUND = ".,;:?!\"'()[]{}<>…“”«»¿"
THRICE = re.compile(r"([^\W\d_])\1\1")
SPACED = re.compile(rf"(?:[^\W_]|[@$€£!])(?:[{re.escape(GAPS)}]{{1,3}}(?:[^\W_]|[@$€£!])){{2,}}")
TAIL = re.compile(r"([^\w\s])\1\1+\Z")
WORD = re.compile(r"[^\W_]+")
ZERO = re.compile("[\u200b-\u200f\u2060\ufeff\u00ad]")
#: The price of a word's end between letters that stand apart.
GAP = 1.0
# fixed values: letters of other scripts by the Latin ones they look like
TWINS = str.maketrans("\u0430\u0441\u0435\u0456\u0458\u043e\u0440\u0455\u0445\u0443\u0442\u043c\u043d\u043a\u0432\u03b1\u03bf\u03c1\u03b9\u03bd\u03ba\u03c4\u03c5", "aceijopsxytmnkbaopivktu")
FOREIGN = re.compile("[\u0370-\u03ff\u0400-\u04ff\uff00-\uffef\U0001d400-\U0001d7ff]")
LATIN = re.compile("[a-z]")


class CharModel:
    """Trigrams of the letters of words with add-k smoothing over a bigram; costs in nats."""

    def __init__(self, words: Counter):
        tri, bi, two, uni = Counter(), Counter(), Counter(), Counter()
        for w, n in words.items():
            s = "  " + w + " "
            for i in range(2, len(s)):
                tri[s[i - 2 : i + 1]] += n
                bi[s[i - 2 : i]] += n
                two[s[i - 1 : i + 1]] += n
                uni[s[i - 1]] += n
        self.costs: dict[str, float] = {}
        self.tri, self.bi, self.two, self.uni, self.size = tri, bi, two, uni, max(30, len(uni))

    def cost(self, gram: str) -> float:
        c = self.costs.get(gram)
        if c is None:
            low = (self.two[gram[1:]] + 0.2) / (self.uni[gram[1]] + 0.2 * self.size)
            c = self.costs[gram] = -math.log((self.tri[gram] + 3 * low) / (self.bi[gram[:2]] + 3))
        return c


def decode(model: CharModel, spots: list[list[tuple[str, float]]], gap: float | None = None) -> str:
    """The cheapest reading of a lattice: for each place, strings of 0 to 2 letters with their costs.

    gap: the price of a word's end before a place, beyond what the model asks for it; None: one word.
    Each state keeps the way it came by, so the work grows with the length alone.
    """
    beams: dict[str, tuple[float, tuple]] = {"  ": (0.0, ())}
    for k, options in enumerate(spots):
        nxt: dict[str, tuple[float, tuple]] = {}
        if gap is not None and k:
            starts = {"  ": min((c + model.cost(st + " ") + gap, (" ", way)) for st, (c, way) in beams.items())}
            beams = beams | starts if "  " not in beams else beams
        for state, (c, way) in beams.items():
            for s, price in options:
                st, total = state, c + price
                for ch in s:
                    total += model.cost(st + ch)
                    st = st[1] + ch
                if (old := nxt.get(st)) is None or total < old[0]:
                    nxt[st] = (total, (s, way) if s else way)
        beams = nxt
    way, out = min((c + model.cost(st + " "), st, way) for st, (c, way) in beams.items())[2], []
    while way:
        s, way = way
        out.append(s)
    return "".join(reversed(out))


def lattice(s: str) -> list[list[tuple[str, float]]]:
    """A run of one letter is that letter once or twice; a sign one of its letters, or itself at a price, or, at an end, nothing."""
    spots, i = [], 0
    while i < len(s):
        ch, j = s[i], i + 1
        while j < len(s) and s[j] == ch:
            j += 1
        n = j - i
        if ch in LOOKS:
            options = [(x, 0.7) for x in LOOKS[ch]]
            if ch.isdigit():
                options.append((ch * n, 6.0))
            if i == 0 or j == len(s):
                options.append(("", 7.0 if i == 0 else 4.0 if ch.isdigit() else 2.0))
            if n > 1 or ch in "05$":
                options += [(x * 2, 1.0) for x in LOOKS[ch]] if n == 2 else []
        else:
            options = [(ch, 0.0 if n != 2 else 1.5)]
            if n >= 2:
                options.append((ch * 2, 0.0 if n == 2 else 0.7))
        spots.append(options)
        i = j
    return spots


def plain(text: str | None) -> str:
    """Lower case; full-width and mathematical letters as plain ones, and those of other scripts in a word with Latin letters as what they look like."""
    t = (text or "").lower()
    if not FOREIGN.search(t):
        return t
    words = [unicodedata.normalize("NFKC", w).lower() if FOREIGN.search(w) else w for w in re.split(r"(\s+)", t)]
    return "".join(w.translate(TWINS) if FOREIGN.search(w) and LATIN.search(w) else w for w in words)


class Restorer:
    """Restores text word by word; white space becomes one space. Decoded words are remembered, so many at most."""

    def __init__(self, model: CharModel, remember: int = 50_000):
        self.model, self.remember, self.memo = model, remember, {}

    def decoded(self, s: str, gap: float | None = None) -> str:
        return decode(self.model, lattice(s), gap)

    def _odd(self, token: str) -> str:
        """A token that isn't plain letters."""
        core = TAIL.sub("", token.strip(AROUND) or token)
        if core.isalpha():
            return self.decoded(core) if THRICE.search(core) else core
        if not any(map(str.isalpha, core)):
            return token
        bare = ZERO.sub("", core)
        if SPACED.fullmatch(bare):
            bare = "".join(x for x in bare if x not in GAPS)
            return self.decoded(bare)
        inner = token.lstrip(AROUND.replace("!", "")).rstrip(AROUND)
        inner = TAIL.sub("", ZERO.sub("", inner)) or bare
        # what stands between other marks is decoded by itself
        return " ".join(self.decoded(x) if x in LOOKS or any(map(str.isalpha, x)) and any(y in LOOKS for y in x) or THRICE.search(x) else x for x in re.split(r"[^\w" + re.escape("".join(LOOKS)) + r"]+|_+", inner) if x)

    def word(self, token: str) -> str:
        got = self.memo.get(token)
        if got is None:
            if len(self.memo) >= self.remember:
                self.memo.clear()
            got = self.memo[token] = self.decoded(token) if token.isalpha() else self._odd(token)
        return got

    def _apart(self, tokens: list[str], ones: list[int]) -> list[str]:
        """Runs of three or more tokens of one sign each are one word, if three of them are letters."""
        out, i, done = [], 0, 0
        while i < len(ones):
            j = i
            while j + 1 < len(ones) and ones[j + 1] == ones[j] + 1:
                j += 1
            s = "".join(x for x in tokens[ones[i] : ones[j] + 1] if x not in GAPS)
            if j - i >= 2 and sum(map(str.isalpha, s)) >= 3:
                out += tokens[done : ones[i]]
                out += self.decoded(s, GAP).split()
                done = ones[j] + 1
            i = j + 1
        return out + tokens[done:]

    def words(self, text: str) -> list[str]:
        """text: as plain() gives it."""
        tokens = text.split()
        ones = [i for i, x in enumerate(tokens) if len(x) == 1]
        if len(ones) > 2:
            tokens = self._apart(tokens, ones)
        return tokens

    def distinct(self, text: str | None) -> set[str]:
        """The distinct restored words of a text."""
        thrice = THRICE.search
        text = plain(text)
        tokens = set(self.words(text))
        cores = {x.strip(AROUND) for x in tokens}
        odd = {x for x in cores if not x.isalpha()}
        if thrice(text):
            odd |= {x for x in cores if thrice(x)}
        out = cores - odd
        if odd:
            for x in tokens:
                if x.strip(AROUND) in odd:
                    out.update(WORD.findall(self.word(x if not x.strip(AROUND).isalpha() else x.strip(AROUND))))
        return out

    def __call__(self, text: str | None) -> str:
        letters, thrice = str.isalpha, THRICE.search
        return " ".join(x if letters(x.strip(AROUND) or x) and not thrice(x) else self.word(x) for x in self.words(plain(text)))


def evidence(words) -> set[str]:
    """Whole words (marked) and beginnings of 4 to 7 letters."""
    out = set()
    for w in words:
        out.add(w + "$")
        for k in range(4, min(len(w), 7) + 1):
            out.add(w[:k])
    return out


class Lexicon:
    """Evidence strings with their weights; base and slope turn a text's sum into log odds."""

    def __init__(self, weights: dict[str, float], base: float = 0.0, slope: float = 1.0):
        self.weights, self.base, self.slope = weights, base, slope
        self.starts = {k[:4] for k in weights if len(k.rstrip("$")) >= 4}

    def total(self, words: set[str]) -> float:
        """The sum over words of each one's strongest evidence."""
        w, starts, sum_ = self.weights, self.starts, 0.0
        for word in words:
            if word[:4] in starts:
                sum_ += max(w.get(word + "$", 0.0), *(w.get(word[:k], 0.0) for k in range(4, min(len(word), 7) + 1)))
            elif len(word) < 4:
                sum_ += w.get(word + "$", 0.0)
        return sum_

    def score(self, words: set[str]) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.base + self.slope * self.total(words)))))


#: Distinct strings that a task counts before it hands its counts on.
HELD = 1 << 18


def _letters(it):
    seen, top = Counter(), Counter()

    def spell():
        for w, n in seen.items():
            s = "  " + w + " "
            for i in range(2, len(s)):
                top[s[i - 2 : i + 1]] += n
        seen.clear()

    for df in it:
        for t in df.text:
            seen.update(w for w in WORD.findall((t or "").lower()) if w.isalpha() and len(w) > 1)
            if len(seen) > HELD:
                spell()
    spell()
    yield pd.DataFrame({"g": pd.Series(list(top), dtype=object), "n": pd.Series(list(top.values()), dtype="int64")})


def char_model(train: DataFrame) -> CharModel:
    """From the counts of all trigrams of the training texts; the distinct ones reach the driver."""
    rows = train.select("text").mapInPandas(_letters, "g string, n long").groupBy("g").agg(F.sum("n").alias("n")).collect()
    m = CharModel(Counter())
    for g, n in rows:
        m.tri[g] += n
        m.bi[g[:2]] += n
        m.two[g[1:]] += n
        m.uni[g[1]] += n
    m.size = max(30, len(m.uni))
    return m


def _evidence(restore: Restorer, wanted: set[str] | None = None):
    """How many texts hold each string, or each of the wanted ones; '' stands for all texts."""
    starts = wanted and {f[:4] for f in wanted}

    def run(it):
        seen, n = Counter(), 0

        def told():
            return pd.DataFrame({"f": pd.Series([*seen, ""], dtype=object), "n": pd.Series([*seen.values(), n], dtype="int64")})

        for df in it:
            for t in df.text:
                n += 1
                words = restore.distinct(t)
                if wanted is None:
                    seen.update(evidence(words))
                else:
                    seen.update(evidence(w for w in words if (w + "$")[:4] in starts) & wanted)
                if len(seen) > HELD:
                    yield told()
                    seen, n = Counter(), 0
        yield told()

    return run


def _counted(rows: DataFrame, restore: Restorer, wanted: set[str] | None = None) -> DataFrame:
    return rows.select("text").mapInPandas(_evidence(restore, wanted), "f string, n long").groupBy("f").agg(F.sum("n").alias("n"))


def fit(train: DataFrame, least: int = 5) -> tuple[Restorer, Lexicon]:
    """train: (doc_id, text, y). In three quarters of it, strings of `least` or more toxic texts, and of a hundredth of them, that
    are far likelier there make the lexicon; the last quarter sets base and slope. The strings that so many toxic texts hold, a
    hundred times as many as one text holds at most, are counted in the clean ones."""
    restore, learn = Restorer(char_model(train)), F.expr("pmod(xxhash64(doc_id, 7), 4) > 0")
    n0, n1 = (train.filter(learn).filter(y).count() for y in ("not y > 0", "y > 0"))
    if not n0 or not n1:
        return restore, Lexicon({}, 10.0 if n1 else -10.0 if n0 else 0.0)
    least = max(least, math.ceil(0.01 * n1))
    toxic = {r.f: r.n for r in _counted(train.filter(learn).filter("y > 0"), restore).filter(f"f != '' and n >= {least}").collect()}
    clean = {r.f: r.n for r in _counted(train.filter(learn).filter("not y > 0"), restore, set(toxic)).collect()} if toxic else {}
    weights = {f: gain for f, n in toxic.items() if (gain := _gain(n, n1, clean.get(f, 0), n0)) > 3}
    lexicon = Lexicon(weights)
    totals = train.filter(~learn).select("text", "y").mapInPandas(_totals(restore, lexicon), "total double, y double")
    totals = store(totals.groupBy("total", "y").agg(F.count("*").alias("n")))
    lexicon.base, lexicon.slope = newton(_slopes(totals))
    forget(totals)
    return restore, lexicon


def _gain(toxic: int, n1: int, clean: int, n0: int) -> float:
    """Log odds of a lower bound of the toxic share against an upper bound of the clean one."""
    return math.log((toxic - 1.64 * math.sqrt(toxic)) / n1 + 1e-9) - math.log((clean + 1.64 * math.sqrt(clean + 1.0)) / n0)


def _slopes(totals: DataFrame):
    """totals: (total, y, n). At given coefficients, gradient and curvature summed over all rows."""
    def at(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.lit(float(w[0])) + F.lit(float(w[1])) * F.col("total")))
        df = totals.withColumn("p", 1 / (1 + F.exp(-z))).withColumn("g", F.col("n") * (F.col("p") - F.col("y"))).withColumn("h", F.col("n") * F.col("p") * (1 - F.col("p")))
        x = F.col("total")
        g0, g1, h0, h1, h2 = (v or 0.0 for v in df.agg(F.sum("g"), F.sum(F.col("g") * x), F.sum("h"), F.sum(F.col("h") * x), F.sum(F.col("h") * x * x)).first())
        return np.array([g0, g1]), np.array([[h0, h1], [h1, h2]])

    return at


def newton(slopes, ridge: float = 0.05) -> tuple[float, float]:
    """Base and slope by Newton steps; slopes: gradient and curvature at given coefficients."""
    w = np.array([-4.0, 1.0])
    prior = w.copy()
    for _ in range(30):
        (g, h), old = slopes(w), w
        w = w - np.linalg.solve(h + ridge * np.eye(2), g + ridge * (w - prior))
        w[1] = max(w[1], 0.1)
        if np.abs(w - old).max() < 1e-12:
            break
    return float(w[0]), float(w[1])


def logistic(x: list[float], y: list[float], ridge: float = 0.05) -> tuple[float, float]:
    """Base and slope of y on x, both lists."""
    x, y = np.array([np.ones(len(x)), x]), np.array(y)

    def slopes(w):
        p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
        return x @ (p - y), (x * (p * (1 - p))) @ x.T

    return newton(slopes, ridge)


def _totals(restore: Restorer, lexicon: Lexicon):
    def run(it):
        for df in it:
            yield pd.DataFrame({"total": [lexicon.total(restore.distinct(t)) for t in df.text], "y": (df.y > 0).astype(float)})

    return run


def _score(restore: Restorer, lexicon: Lexicon):
    def run(it):
        for b in it:
            s = [lexicon.score(restore.distinct(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    return run


def _restore(restore: Restorer):
    def run(it):
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([restore(t) for t in b.column(1).to_pylist()], pa.string())], names=["doc_id", "restored"])

    return run


def trained(docs: DataFrame, labels: DataFrame) -> tuple[Restorer, Lexicon]:
    """Learnt from every labelled row outside the held-out remainder."""
    train = store(training(docs, labels, "toxic", 4, 2))
    model = fit(train)
    forget(train)
    return model


def restored(docs: DataFrame, restore: Restorer) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_restore(restore), "doc_id long, restored string")


def classify(docs: DataFrame, restore: Restorer, lexicon: Lexicon) -> DataFrame:
    """(doc_id, score) for every row."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_score(restore, lexicon), "doc_id long, score double")


def scoring(restore: Restorer, lexicon: Lexicon):
    """A column function of the text, for filters that keep their other columns."""

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return text.map(lambda t: lexicon.score(restore.distinct(t)), na_action=None).astype(float)

    return score


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = classify(docs, *trained(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
