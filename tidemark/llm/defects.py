"""Broken question and answer pairs: empty, copied, refused, wrong-language and truncated answers.

Languages come from a character n-gram naive Bayes model whose training texts are labelled by the common words of each language;
the posteriors of question and answer are compared. Truncation comes from a naive Bayes model of text ends: the suffix n-grams
of answers cut at their sentence ends against those of the same answers cut anywhere else. Refusals come from a naive Bayes model of
word n-grams, taught by the hints low_evidence and n_citations. All models are fitted on a bounded sample of the pairs (SAMPLE
rows, by a hash of the key); every pair is judged.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import shuffle_partitions

#: Rows that the two models are fitted on, at most.
SAMPLE = 4000

CITATION = re.compile(r"\s*\[\d+\]")
QUOTED = re.compile(r"[(\[]?\s*(?:«[^»]*»|“[^”]*”|„[^“”]*[“”]|\"[^\"]*\")\s*[)\]]?")
NUMBER = re.compile(r"\d+(?:[.,:]\d+)*")
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
#: Placeholders that stand for no answer (fixed values).
PLACEHOLDERS = {"null", "none", "nil", "nan", "na", "n a", "n/a", "tbd", "todo", "tba", "empty", "undefined", "unknown", "no answer", "not available", "missing", "blank", "xxx", "keine antwort", "sin respuesta", "pas de réponse", "leer", "vacío", "vide", "placeholder", "test"}
#: General refusals and plain answers that the refusal model starts from, so that it has an opinion where no row is labelled.
SEED_REFUSALS = [
    "I do not know.", "I don't know the answer to that.", "I don't know that.", "I cannot answer this question.", "I can't answer what happened there.", "I'm sorry, but I can't help with that.", "Sorry, I cannot say.",
    "Sorry, none of the videos mention this.", "None of the sources cover this.", "None of the videos cover this.", "There is no information about this in the sources.", "I have no information on that.", "I am not able to say.",
    "Es tut mir leid, das weiß ich nicht.", "Tut mir leid, dazu weiß ich nichts.", "Ich weiß nichts über dieses Thema.", "Darauf kann ich nicht antworten.", "Dazu gibt es keine Angaben.", "Keines der Videos behandelt das.", "Ich kann das nicht beantworten.",
    "Lo siento, no lo sé.", "Lo siento, no puedo responder a eso.", "No encuentro nada sobre este tema.", "No hay información sobre eso.", "Ningún vídeo habla de esto.", "No tengo datos sobre eso.",
    "Désolé, je ne sais pas.", "Désolé, je ne peux pas répondre à cette question.", "Je n’ai rien trouvé sur ce sujet.", "Il n’y a aucune information sur ce sujet.", "Aucune vidéo ne parle de cela.", "Je n’ai pas de réponse.",
]
SEED_ANSWERS = [
    "The pump at Calder was closed in 1998.", "He said that 12 boats had left the harbour, and the crew measured 40 metres.", "It took 3 years because the ground was wet.", "The answer came from Brimley, and the second reply was longer.", "She was the first to answer the call at the mill.",
    "Das Rad bei Brimley wurde 1998 repariert.", "Er hat 12 Boote gezählt, weil der Hafen voll war.", "Die Mühle war nach 3 Jahren wieder offen.",
    "El muelle de Calder se cerró en 1998.", "Dijo que 12 barcos salieron del puerto.", "La obra duró 3 años porque llovía.",
    "Le moulin de Brimley a été fermé en 1998.", "Il a compté 12 bateaux dans le port.", "Le travail a duré 3 ans parce que le sol était humide.",
]
LANGUAGES = ["en", "fr", "de", "es"]


def grams(text: str) -> list[str]:
    """Character n-grams (2 to 4) of the words with their bounds; digits and capitalized words inside the text (names) are left out."""
    out = []
    words = [w for i, w in enumerate(WORD.findall(text)) if not any(c.isdigit() for c in w) and (i == 0 or not w[:1].isupper())]
    for w in words:
        s = f"^{w.lower()}$"
        for n in (2, 3, 4):
            out += [s[i : i + n] for i in range(len(s) - n + 1)]
        if len(s) <= 6:
            out.append(s)
    return out


class Languages:
    """Naive Bayes over character n-grams."""

    def __init__(self, texts: list[str], common: dict[str, set[str]]):
        self.names = sorted(common)
        counts = {k: Counter() for k in self.names}
        for words in common:
            for w in sorted(common[words]):
                counts[words].update(grams(w))
        for t in texts:
            label = self._vote(t, common)
            if label:
                counts[label].update(grams(t))
        known = set().union(*counts.values()) if counts else set()
        self.logs: dict[str, tuple[float, ...]] = {}
        totals = {k: sum(counts[k].values()) + 0.3 * len(known) for k in self.names}
        for g in known:
            self.logs[g] = tuple(math.log((counts[k][g] + 0.3) / totals[k]) for k in self.names)

    @staticmethod
    def _vote(text: str, common: dict[str, set[str]]) -> str | None:
        words = [w.lower() for w in WORD.findall(text)]
        votes = sorted(((sum(w in c for w in words), k) for k, c in common.items()), reverse=True)
        return votes[0][1] if votes and votes[0][0] >= 3 and (len(votes) < 2 or votes[0][0] >= 2 * votes[1][0]) else None

    def scores(self, text: str) -> tuple[dict[str, float], int]:
        """Log likelihoods by language, and the number of known n-grams."""
        total, n = [0.0] * len(self.names), 0
        for g in grams(text):
            logs = self.logs.get(g)
            if logs is not None:
                n += 1
                for i, x in enumerate(logs):
                    total[i] += x
        return dict(zip(self.names, total)), n


def shape(text: str) -> str:
    """The end of a text with digits as 0 and capitals as A."""
    return "".join("0" if c.isdigit() else "A" if c.isupper() else c for c in text.rstrip()[-12:])


def suffixes(text: str) -> list[str]:
    s = shape(text)
    last = re.split(r"\s+", text.rstrip())[-1][-12:].lower() if text.strip() else ""
    return [f"{n}{s[-n:]}" for n in (1, 2, 3, 4, 5) if len(s) >= n] + [f"w{re.sub(r'[0-9]', '0', last)}"]


def phrases(text: str) -> set[str]:
    """Runs of one to three words within the sentences of a text, their bounds included; numbers and names inside a sentence are classes."""
    out: set[str] = set()
    for sentence in re.split(r"(?<=[.!?…])\s+|\n", text):
        words = ["<"]
        for i, m in enumerate(WORD.finditer(sentence)):
            w = m.group()
            words.append("0" if any(c.isdigit() for c in w) else "A" if i and w[:1].isupper() and len(w) > 1 else w.lower())
        words.append(">")
        for n in (1, 2, 3):
            out.update(" ".join(words[i : i + n]) for i in range(len(words) - n + 1))
    return out - {"<", ">", "< >"}


def answer_body(answer: str) -> str:
    """An answer without citations and quotations."""
    return QUOTED.sub(" ", CITATION.sub("", answer))


class Refusals:
    """Naive Bayes over word n-grams: refusals against answers.

    ``rows``: (answer, low_evidence, n_citations). An answer with low evidence and no citation counts as a refusal, one with
    evidence and citations as an answer; the others teach nothing. These hints are often wrong for a single row, yet what they
    share over many rows is the wording of refusals. An answer that reports a refusal and then states facts has the phrases of both.
    """

    def __init__(self, rows: list[tuple]):
        said = {True: Counter(), False: Counter()}
        n = {True: 0, False: 0}
        taught = [(t, True) for t in SEED_REFUSALS] + [(t, False) for t in SEED_ANSWERS]
        taught += [(answer_body(a), bool(low)) for a, low, cited in rows if (low is True and cited == 0) or (low is False and cited is not None and cited > 0)]
        for text, refuses in taught:
            said[refuses].update(phrases(text))
            n[refuses] += 1
        seeds = set().union(*(phrases(t) for t in SEED_REFUSALS + SEED_ANSWERS))
        known = {g for g in set(said[True]) | set(said[False]) if said[True][g] + said[False][g] > 1 or g in seeds}
        self.logs = {g: math.log((said[True][g] + 0.2) / (n[True] + 0.4)) - math.log((said[False][g] + 0.2) / (n[False] + 0.4)) for g in known}

    def score(self, answer: str) -> float:
        """Log likelihood ratio of a refusal against an answer."""
        return sum(self.logs.get(g, 0.0) for g in phrases(answer_body(answer)))


SENTENCE = re.compile(r"[.!?](?=\s|\Z)(?:\s*\[\d+\])*(?:\s*\(«[^»]*»\))?")


class Ends:
    """Naive Bayes of text ends: suffix n-grams at sentence ends against suffix n-grams of cuts elsewhere."""

    def __init__(self, texts: list[str], seed: int = 5):
        rng = random.Random(seed)
        good, bad = Counter(), Counter()
        n_good = n_bad = 0
        for t in texts:
            ends = [m.end() for m in SENTENCE.finditer(t)]
            for e in ends[:4]:
                # A last full stop may be missing before a citation.
                for s in {t[:e], re.sub(r"[.](\s*\[\d+\])\Z", r"\1", t[:e])}:
                    good.update(set(suffixes(s)))
                    n_good += 1
            inner = [i for i in range(20, len(t)) if i not in ends]
            for i in rng.sample(inner, min(6, len(inner))):
                s = t[:i].rstrip()
                if SENTENCE.search(s[-12:]) and re.search(r"[.!?](\s*\[\d+\])?\Z", s):
                    continue
                s = re.sub(r"\[\Z", "", s)
                s = rng.choice((s, s, s, s, s + "-", s + "…", s + "...", s + " ...", s + " …", s + ",", s + " [1"))
                bad.update(set(suffixes(s)))
                n_bad += 1
        self.logs = {g: math.log((good[g] + 0.5) / (n_good + 1)) - math.log((bad[g] + 0.5) / (n_bad + 1)) for g in set(good) | set(bad)}

    def complete(self, text: str) -> float:
        """Log likelihood ratio of an end against a cut, the longest known evidence counting as much as each shorter one."""
        return sum(self.logs.get(g, 0.0) for g in suffixes(text))


def _trigrams(s: str) -> set[str]:
    s = re.sub(r"[\W_]+", " ", s.lower()).strip()
    return {s[i : i + 3] for i in range(max(1, len(s) - 2))}


LEAD = re.compile(r"\A\s*(?:you asked|q|a|question|answer|frage|antwort|pregunta|respuesta|vous avez demandé|sie fragten|usted preguntó)\s*:\s*|\n\s*(?:a|answer|antwort|respuesta|réponse)\s*:\s*", re.IGNORECASE)


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    s = CITATION.sub("", answer)
    words = WORD.findall(s)
    plain = " ".join(w.lower() for w in words)
    return not words or plain in PLACEHOLDERS or re.sub(r"[\W_]+", "", s.lower()) in {re.sub(r"\W+", "", p) for p in PLACEHOLDERS}


def is_copy(q: str | None, answer: str) -> bool:
    """Nothing but the question again: nearly all character trigrams of each occur in the other."""
    if not q or not WORD.search(q):
        return False
    a, b = _trigrams(LEAD.sub(" ", CITATION.sub("", answer))), _trigrams(q)
    if not a or not b:
        return False
    both = len(a & b)
    return both >= 0.75 * len(a) and both >= 0.7 * len(b)


def judge(q: str | None, answer: str | None, languages: Languages, ends: Ends, refusals: Refusals | None = None) -> str | None:
    """The defect of a pair, or None. Defects are looked for in this order: empty, copy, refusal, other_language, truncated.

    Without a refusal model the one of the seed texts alone is used.
    """
    refusals = refusals or SEEDED
    if is_empty(answer):
        return "empty"
    if is_copy(q, answer):
        return "copy"
    plain, body = CITATION.sub("", answer), answer_body(answer)
    if refusals.score(answer) > 0 and not {*NUMBER.findall(body)} - {*NUMBER.findall(q or "")}:  # the question's own numbers are no fact
        return "refusal"
    words = WORD.findall(plain)
    if q and len(words) > 3:
        mine, n = languages.scores(q)
        theirs, m = languages.scores(body)
        if n >= 8 and m >= 8:
            asked, said = max(mine, key=mine.get), max(theirs, key=theirs.get)
            if asked != said and theirs[said] - theirs[asked] > max(6.0, 0.12 * m) and mine[asked] - mine[said] > 3.0:
                return "other_language"
    open_end = answer.rstrip()[-1:] in "…,-–" or answer.rstrip().endswith("..") or re.search(r"\[\d*\Z", answer.rstrip())
    if len(words) <= 3 and not open_end:
        return None
    if ends.complete(answer) < 0:
        return "truncated"
    return None


SEEDED = Refusals([])


def broken_pairs(pairs: DataFrame, words: DataFrame, key: str = "probe_id", q: str = "q", answer: str = "answer", sample: int = SAMPLE) -> DataFrame:
    """``key, defect`` of every pair with a defect: empty, truncated, refusal, copy or other_language.

    Repeated rows of a key count once. A null or blank answer is empty; with a null question only empty, refusal and truncated can be
    told. ``low_evidence`` and ``n_citations``, where ``pairs`` has them, teach the refusal model and decide nothing by themselves. ``words``: the common words by language (a small fixed table, checked against 100,000 rows). Other columns are ignored.
    """
    hint = lambda name, kind: (F.col(name) if name in pairs.columns else F.lit(None)).cast(kind)
    rows = pairs.select(F.col(key).alias("key"), F.col(q).cast("string").alias("q"), F.col(answer).cast("string").alias("answer"), hint("low_evidence", "boolean").alias("low"), hint("n_citations", "bigint").alias("cited"))
    rows = rows.where(F.col("key").isNotNull()).repartition(shuffle_partitions(pairs.sparkSession), "key").dropDuplicates(["key"])
    got = words.where("lang is not null and word is not null").select("lang", F.lower("word")).limit(100_001).collect()
    if len(got) > 100_000:
        raise ValueError("more than 100,000 common words")
    common: dict[str, set[str]] = {}
    for lang, w in got:
        common.setdefault(lang, set()).add(w)
    some = rows.orderBy(F.xxhash64("key"), "key").limit(sample).collect()
    languages = Languages([t for r in some for t in (r["q"], r["answer"]) if t], common)
    ends = Ends([r["answer"] for r in some if r["answer"] and len(r["answer"]) > 40])
    # An empty answer and a repeated question teach nothing about refusals.
    refusals = Refusals([(r["answer"], r["low"], r["cited"]) for r in some if not is_empty(r["answer"]) and not is_copy(r["q"], r["answer"])])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["defect"] = [judge(x or None, y, languages, ends, refusals) for x, y in zip(pdf["q"], pdf["answer"])]
            yield pdf.loc[pdf["defect"].notna(), ["key", "defect"]]

    out = rows.mapInPandas(run, f"key {rows.schema['key'].dataType.simpleString()}, defect string")
    return out.withColumnRenamed("key", key)
