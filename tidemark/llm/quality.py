"""Per-document text statistics, and from them whether a document is prose, a list, a table or junk.

Gradient-boosted trees are trained on the statistics of a bounded sample of documents that carry a weak label (structural rules
that speak up only where nearly all of a document is of one kind), and their probabilities are calibrated on a hand-checked holdout.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.boosting import BoostedTrees
from tidemark.llm.holdout import CHECKED
from tidemark.session import spread

KINDS = ["prose", "list", "table", "junk"]
#: Documents of which the classifier is trained, at most about this many (a sample by a hash of the key).
SAMPLE = 3000

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
SENTENCE_END = re.compile(r"[.!?…:;]['\"»”)\]]*\s*\Z")
STOP = re.compile(r"[.!?…]['\"»”)\]]*(?=\s|\Z)")
BULLET = re.compile(r"\s*(?:[-*•–—→▪◦‣·+]\s|\[[ xX]\]\s?|\(?\d{1,3}\s?[.)\]]\s|\d{1,3}\s[-–]\s|[a-z]\)\s)")
NUMBERED = re.compile(r"\s*\d{1,3}[.](?=\s)")
CHAPTER = re.compile(r"\s*[\[(]?\d{1,2}:\d{2}(?::\d{2})?[\])]?\s")
LINK = re.compile(r"\b(?:https?://|www\.)\S+")
HASHTAG = re.compile(r"(?<!\w)#\w+")
TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
RULE = re.compile(r"\s*[+|:]?[-=+|:\s]{5,}\Z")
#: Characters that wrong decodings of Latin text leave behind, control characters and the replacement character.
BROKEN = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f�▀-◿]|[ÃÂÅÐÑ][\u0080-¿Œ-Ÿˆ-€�]?|[¤§¼½¾©®€œŒ]")
VOWELS = set("aeiouyáéíóúàèìòùâêîôûäëïöüåæøãõœ")
CLUSTER = re.compile(r"[bcdfghjklmnpqrstvwxz]{5,}")
CODED = re.compile(r"(?<!\S)(?=\S*[a-z])(?=\S*[A-Z])(?=\S*[\d+/=])[A-Za-z\d+/=_-]{16,}|(?<!\S)[0-9a-fA-F]{16,}(?!\S)|(?<!\S)\S{60,}(?!\S)")
SEPARATORS = ("\t", "|", ";", ",", "  ")
WIDE_GAP = re.compile(r"(?<=\S) {2,}(?=\S)")

NAMES = [
    "n_words", "mean_word_len", "symbol_ratio", "punct_line_share", "common_share", "digit_share", "upper_share", "broken_share", "odd_word_share", "coded_share", "n_lines", "mean_line_len",
    "table_share", "columns", "entry_share", "bullet_share", "link_share", "hashtag_share", "item_share", "markup_share", "brace_share", "repeat_share", "vocabulary_growth", "wrap_share",
    "stop_share", "words_per_stop", "long_token", "space_share", "entry_lines", "garbled_word_share",
]


def _row_cells(lines: list[str]) -> tuple[float, int]:
    """Share of the characters in rows of cells, and the columns: the separator whose most frequent count covers most lines."""
    total = sum(map(len, lines)) or 1
    best, columns = 0.0, 0
    whole = "\n".join(lines)
    rules = [x[0] in "+|:-= " and bool(RULE.match(x)) for x in lines]
    for name in SEPARATORS:
        if whole.count(name) < 2:
            continue
        counts = [0 if r else len(WIDE_GAP.findall(x)) if name == "  " else x.count(name) for x, r in zip(lines, rules)]
        if name == "  ":  # an empty cell leaves fewer gaps
            top = max(counts, default=0)
            ok = [c > 0 and c <= 8 for c in counts]
            if sum(ok) < 2:
                continue
        else:
            seen = Counter(c for c in counts if c)
            if not seen:
                continue
            top, n = seen.most_common(1)[0]
            if n < 2:
                continue
            if name in ",;":
                # Cells hold no sentences: rows of one count with short cells.
                ok = [c == top and not STOP.search(x) and len(x.split()) <= 2.2 * (c + 1) for c, x in zip(counts, lines)]
            else:
                ok = [c > 0 and abs(c - top) <= 1 and len(x.split()) <= 4 * (c + 1) for c, x in zip(counts, lines)]
        share = sum(len(x) for x, o, r in zip(lines, ok, rules) if o or r) / total
        if share > best + 0.05:
            best, columns = share, top + 1
    return best, columns


def _classes() -> np.ndarray:
    """Flags of the characters of the basic plane: 1 no white space, 2 letter or digit, 4 digit, 8 upper case."""
    kept = _classes.__dict__.setdefault("table", None)
    if kept is None:
        kept = np.array([(not c.isspace()) + 2 * c.isalnum() + 4 * c.isdigit() + 8 * c.isupper() for c in map(chr, range(1 << 16))], np.uint8)
        _classes.table = kept
    return kept


def _odd(word: str, common: set[str], known: dict[str, bool]) -> bool:
    """Whether a word looks like random letters; remembered, within a bound."""
    got = known.get(word)
    if got is None:
        if len(known) > 200_000:
            known.clear()
        v = sum(c in VOWELS for c in word)
        n = len(word)
        got = known[word] = (n > 2 and v < 0.2 * n) or (n > 4 and bool(CLUSTER.search(word))) or (n == 1 and word not in common and word not in "aeiouyà")
    return got


def statistics(text: str, common: set[str], known_words: dict[str, bool] | None = None) -> list[float]:
    """The statistics of one text, in the order of NAMES. All are defined for empty and blank texts (0).

    ``known_words`` remembers what words look like, for one set of common words.
    """
    known_words = {} if known_words is None else known_words
    words = WORD.findall(text)
    n = len(words)
    lower = [w.lower() for w in words]
    size = len(text)
    flags = _classes()[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 0xFFFF)]
    solid = int(np.count_nonzero(flags & 1)) or 1
    alnum, digits, upper = (int(np.count_nonzero(flags & f)) for f in (2, 4, 8))
    lines = [x for x in text.splitlines() if x.strip()]
    chars = sum(map(len, lines)) or 1
    counted = Counter(lower)
    known = sum(k for w, k in counted.items() if w in common)
    odd = sum(k for w, k in counted.items() if _odd(w, common, known_words))
    broken = len(BROKEN.findall(text))
    tokens = text.split()
    garbled = sum(1 for t in tokens if BROKEN.search(t)) / max(1, len(tokens)) if broken else 0
    coded = sum(len(t) for t in tokens if len(t) >= 16 and CODED.match(t))
    table, columns = _row_cells(lines)
    widths = sorted(len(x.rstrip()) for x in lines)
    width = widths[int(0.85 * (len(widths) - 1))] if widths else 0
    wrapped = pairs = 0
    for a, b in zip(lines, lines[1:]):
        pairs += 1
        wrapped += len(a.rstrip()) + 1 + len(b.split(None, 1)[0]) > width or bool(SENTENCE_END.search(a))
    wrap = wrapped / pairs if pairs else 1.0
    bullet = sum(len(x) for x in lines if BULLET.match(x) or CHAPTER.match(x)) / chars
    stops = len(STOP.findall(text)) - sum(bool(NUMBERED.match(x)) for x in lines)
    plain_entries = wrap < 0.6 or (stops == 0 and (wrap < 0.8 or digits == 0))
    entry = entries = 0
    seen: set[str] = set()
    for x in lines:
        w = len(x.split())
        marked = BULLET.match(x) or CHAPTER.match(x) or LINK.search(x)
        short = w <= 12 and not STOP.search(x.rstrip())
        if x.strip() in seen:  # one phrase over and over is no list
            continue
        if (marked and w <= 20) or (plain_entries and short) or (short and x.rstrip().endswith(":") and w <= 4):
            seen.add(x.strip())
            entry += len(x)
            entries += 1
    # Enumerations within a line: short items between commas, nearly none of their words common.
    items = 0
    for x in lines:
        if x.count(",") + x.count(";") + x.count("|") + x.count("·") < 3:
            continue
        parts = [p for p in re.split(r"[,;|·]\s*", re.sub(r"^\s*\w+:\s", "", x)) if p.strip()]
        if len(parts) >= 4 and sum(len(p.split()) for p in parts) / len(parts) <= 2.2 and not STOP.search(x[:-1]):
            items += len(x)
    grams = Counter(zip(lower, lower[1:], lower[2:]))
    repeat = sum(k for k in grams.values() if k > max(3, 0.02 * n)) / max(1, len(grams) and n - 2)
    return [
        n, sum(map(len, words)) / n if n else 0, (solid - alnum) / solid, sum(bool(SENTENCE_END.search(x)) for x in lines) / len(lines) if lines else 0, known / n if n else 0,
        digits / solid, upper / solid, broken / solid, odd / n if n else 0, coded / solid, len(lines), chars / len(lines) if lines else 0,
        table, columns, entry / chars, bullet, sum(map(len, LINK.findall(text))) / solid, sum(map(len, HASHTAG.findall(text))) / solid, items / chars,
        sum(map(len, TAG.findall(text))) / solid, sum(text.count(c) for c in "{}[]\"<>=\\") / solid, repeat, np.log1p(len(counted)) / np.log1p(n) if n else 0, wrap,
        stops / len(lines) if lines else 0, n / (stops + 1), max(map(len, tokens), default=0), 1 - solid / size if size else 0, entries / len(lines) if lines else 0, garbled,
    ]


AT = {name: i for i, name in enumerate(NAMES)}


def weak_label(s: np.ndarray | list[float]) -> int | None:
    """The structural rules: a kind where nearly everything speaks for it, else None."""
    g = lambda name: s[AT[name]]
    if g("broken_share") > 0.12 or g("garbled_word_share") > 0.5 or g("coded_share") > 0.6 or g("markup_share") > 0.6 or (g("odd_word_share") > 0.35 and g("common_share") < 0.15):
        return 3
    if g("symbol_ratio") > 0.6 and g("table_share") < 0.5 or (g("brace_share") > 0.2 and g("common_share") < 0.1) or (g("repeat_share") > 0.7 and g("vocabulary_growth") < 0.7 and g("n_words") > 20):
        return 3
    if g("table_share") > 0.6 and g("columns") >= 2 and g("common_share") < 0.36 and g("stop_share") < 0.26 and g("link_share") < 0.2:
        return 2
    if g("n_lines") >= 2 and g("entry_share") > 0.8 and g("stop_share") < 0.3 and g("table_share") < 0.5:
        return 1
    if (g("hashtag_share") > 0.6 or g("link_share") > 0.4 or (g("item_share") > 0.8 and g("common_share") < 0.12)) and g("table_share") < 0.5:
        return 1
    # The commas of wrapped sentences can look like cells; full lines and ends of sentences tell them apart.
    no_table = g("table_share") < 0.2 or (g("wrap_share") > 0.8 and g("stop_share") >= 0.2)
    if g("common_share") > 0.2 and g("entry_share") < 0.2 and no_table and g("broken_share") < 0.02 and g("repeat_share") < 0.4 and g("coded_share") < 0.1 and g("bullet_share") < 0.2:
        return 0
    return None


def _features(texts: list[str], common: set[str], known_words: dict[str, bool] | None = None) -> np.ndarray:
    known_words = {} if known_words is None else known_words
    return np.array([statistics(t, common, known_words) for t in texts], np.float64).reshape(len(texts), len(NAMES))


def _inputs(x: np.ndarray) -> np.ndarray:
    """The statistics that the trees see: all but the sizes, so that very long texts are judged by their make-up."""
    x = x.copy()
    x[:, [AT["n_words"], AT["n_lines"]]] = 0
    return x


def train(x: np.ndarray, common: set[str]) -> BoostedTrees:
    """Trees from the weakly labelled rows among ``x`` and the checked examples' own kinds; calibrated on the other half of the checked ones."""
    y = [weak_label(r) for r in x]
    keep = np.array([v is not None for v in y], bool)
    checked, labels = _features([t for _, t in CHECKED], common), np.array([KINDS.index(k) for k, _ in CHECKED])
    # Every second checked text anchors the classes that a small sample may lack; the others are the holdout.
    xs = np.concatenate([x[keep], checked[::2]])
    ys = np.concatenate([np.array([v for v in y if v is not None], np.int64), labels[::2]])
    return BoostedTrees(len(KINDS)).fit(_inputs(xs), ys).calibrate(_inputs(checked[1::2]), labels[1::2])


def _common(words: DataFrame) -> set[str]:
    got = [r[0] for r in words.where("word is not null").select(F.lower("word")).distinct().limit(100_001).collect()]
    if len(got) > 100_000:
        raise ValueError("more than 100,000 common words")
    return set(got)


#: The statistics' patterns as the JVM and SQL engines know them: words, white space, line ends, punctuated ends.
JVM_WORD, JVM_SPACE, JVM_LINE, JVM_END = r"\p{L}+(?:['’]\p{L}+)*", r"\s\p{Z}", r"[\n\r\x0B\x0C\x{85}\x{2028}\x{2029}]", r"[.!?…:;]['\"»”)\]]*[\s\p{Z}]*$"


def document_statistics(docs: DataFrame, words: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and five statistics of every document: n_words, mean_word_len, symbol_ratio, punct_line_share, common_share.

    Null, empty and blank texts have 0 in all of them. Repeated rows are kept; extra columns are ignored. Column expressions alone.
    """
    common = sorted(_common(words))
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    rows = rows.withColumn("w", F.regexp_extract_all(F.lower("t"), F.lit(JVM_WORD), F.lit(0)))
    rows = rows.withColumn("lines", F.filter(F.split("t", JVM_LINE), lambda x: x.rlike(rf"[^{JVM_SPACE}]")))
    solid = F.length(F.regexp_replace("t", rf"[{JVM_SPACE}]", ""))
    symbols = F.length(F.regexp_replace("t", rf"[{JVM_SPACE}\p{{L}}\p{{N}}]", ""))
    share = lambda some, all_: F.when(all_ > 0, some / all_).otherwise(F.lit(0.0))
    n = F.size("w")
    return rows.select(
        F.col("key").alias(key), n.cast("bigint").alias("n_words"), share(F.length(F.array_join("w", "")), n).alias("mean_word_len"), share(symbols, solid).alias("symbol_ratio"),
        share(F.size(F.filter("lines", lambda x: x.rlike(JVM_END))), F.size("lines")).alias("punct_line_share"), share(F.size(F.filter("w", lambda x: x.isin(common))), n).alias("common_share"),
    )


def classify_documents(docs: DataFrame, words: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """``key, kind, probability`` of every document with content; null and blank texts are left out.

    The classifier sees a bounded sample of weakly labelled rows; statistics and classification cover all rows and whole texts.
    """
    common = _common(words)
    rows = spread(docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).where(F.col("text").rlike(r"[^\s\p{Z}]")))
    n = docs.count()
    some = rows.where(F.pmod(F.xxhash64("key"), F.lit(max(1, n // sample))) == 0).select("text")

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, bool] = {}
        for pdf in batches:
            yield pd.DataFrame({"x": list(_features(pdf["text"].tolist(), common, known))})

    measured = some.mapInPandas(measure, "x array<double>").limit(2 * sample).toPandas()
    x = np.stack(measured["x"].to_numpy()) if len(measured) else np.zeros((0, len(NAMES)))
    model = train(x, common)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, bool] = {}
        for pdf in batches:
            p = model.proba(_inputs(_features(pdf["text"].tolist(), common, known)))
            k = p.argmax(1) if len(p) else np.zeros(0, int)
            yield pd.DataFrame({"key": pdf["key"], "kind": [KINDS[i] for i in k], "probability": p.max(1) if len(p) else []})

    out = rows.mapInPandas(run, f"key {rows.schema['key'].dataType.simpleString()}, kind string, probability double")
    return out.withColumnRenamed("key", key)
