"""Raw caption cues into clean, ordered speaker turns.

Every cue is stripped of labels, times, mark-up, sounds, sung lines and hesitations; what still has a spoken word is a case.
Labels are matched to the known people by exact, partial, initial and one-slip forms; each gives a score.

Turns are whole segments of a semi-Markov conditional model over the cases of one video. A segment opens at a case with a label (a
case that names nobody continues the turn before it) and holds labels with one reading in common. Its score is the sum of its
labels' scores, the log probability of a change at its opening, and the log probability of no change at every label inside it. The
probability of a change depends on the pause, on the break of lexical continuity (the case before ends a sentence, this one
begins one) and on the length of the turn so far in cases, so that lengths are no geometric ones. Its weights are fitted to
labelled cases (PAIRS at most). Forward scores with back pointers give the best segmentation.

The cues are range-sorted over the cluster by video and time, and cleaned where they lie. Readings are settled between two cases
of one reading each, so that a partition needs, beyond its own cases, those from the last such case before it and up to the
first one behind it (HISTORY cases at most); bounded summaries carry these, and the open turn, from one partition to the next.
A video with a third of all rows is never gathered in one task.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from math import exp, log1p

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.intervals import ROWS
from tidemark.session import materialize, shuffle_partitions

TIME = r"\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?"
HEAD_TIME = re.compile(rf"\s*(?:[\[(<]\s*{TIME}\s*[\])>]|{TIME}(?=\s|\Z))(?:\s+[-–—]+(?=\s|\Z))?")
HEAD_MARK = re.compile(r"\s*(?:>{1,3}|&gt;&gt;|[-–—•]+)(?=\s|\w|\[|<|\Z)")
VOICE = re.compile(r"\s*<v(?:\.[\w.]+)?\s+([^>]+)>")
BRACKET = re.compile(r"\s*\[([^\[\]]{1,60})\]:?")
COLON = re.compile(r"\s*([^\W\d_][^:\[\]<>♪*()]{0,48}?)\s*:(?=\s|\Z)")
TAG = re.compile(r"<[^<>]*>")
SUNG = re.compile(r"♪[^♪]*♪|[♪♫]+[^♪♫]*\Z")
SOUND = re.compile(r"\[[^\[\]]*\]|\([^()]*\)|\*[^*]*\*|\{[^{}]*\}")
MARKS = re.compile(r"♪|♫|>>+")
ANY_TIME = re.compile(rf"(?<![\d:]){TIME}(?![\d:])")
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
#: Hesitation sounds by form: uh, um, uhm, er, erm, eh, ehm, hm, mm, ah, äh, euh and longer ones.
HESITATION = re.compile(r"(?:u+h*m*|u+m+h*|e+r+m*|e+h+m*|e+m+|h+m+|m{2,}|m+h+m+|a+h+m*|ä+h*m*|e+u+h*m*|ö+h*m*)\Z", re.IGNORECASE)
_SOUNDS = r"u+h+m*|u{2,}m+|u+m{2,}|um(?=,)|e+r+m+|e+h+m*|h+m+|m{2,}|a+h+m*|ä+h+m*|e+u+h+m*|er(?=,)"
_SIGNS = r"(?:\.{2,}|…|[,.](?=\s|\Z))?(?![\w'’])\s*"
#: In German "um" and "er" are words, unless a comma marks them as hesitations.
HESITATION_WITH_SIGNS = re.compile(rf"(?<![\w'’])(?:{_SOUNDS}){_SIGNS}", re.IGNORECASE)
HESITATION_ELSEWHERE = re.compile(rf"(?<![\w'’])(?:{_SOUNDS}|um|er){_SIGNS}", re.IGNORECASE)
GERMAN = re.compile(r"(?<!\w)(?:der|die|das|den|dem|des|hat|war|und|von|kein|bei|ein|eine|unser|jeder|mehr|als|für|rund)(?!\w)", re.IGNORECASE)
TITLES = {"dr", "prof", "professor", "mr", "mrs", "ms", "miss", "sir", "herr", "frau", "m", "mme", "sr", "sra", "host", "guest", "speaker", "moderator"}


def _plain(s: str) -> str:
    s = unicodedata.normalize("NFKD", s.replace(" ", " "))
    return "".join(c for c in s if not unicodedata.combining(c))


def slips(a: str, b: str, most: int = 2) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours between two words, ``most`` + 1 if there are more."""
    # Every slip changes the sets of letters by two members at most.
    if abs(len(a) - len(b)) > most or len(set(a) ^ set(b)) > 2 * most:
        return most + 1
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(row[-1] + 1, one[j] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        two, one = one, row
    return min(one[-1], most + 1)


class People:
    """The known speakers and the reading of labels; readings are remembered, within a bound."""

    def __init__(self, rows: list[tuple]):
        self.people: list[tuple[str, list[str]]] = []
        for speaker_id, *names in rows:
            best = max((n for n in names if n), key=len, default="")
            parts = re.findall(r"[^\W_]+", _plain(best).lower())
            if speaker_id and parts:
                self.people.append((speaker_id, parts))
        self.known: dict[str, list[tuple[str, float]]] = {}

    def read(self, label: str | None) -> list[tuple[str, float]]:
        """Readings of a label, the best ones only, as (speaker_id, score); none if it names nobody known."""
        if not label or not label.strip():
            return []
        got = self.known.get(label)
        if got is None:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[label] = got = self._read(label)
        return got

    def _read(self, label: str) -> list[tuple[str, float]]:
        s = re.sub(r"\([^)]*\)|\[[^\]]*\]?", " ", _plain(label)).strip(" >:-–—•\t")
        s = re.sub(r"(?<=[a-zäöüß])(?=[A-Z])", " ", s)
        words = [w.lower().replace("0", "o").replace("1", "l") for w in re.findall(r"[^\W_]+", s)]
        if len(words) > 1:
            words = [w for w in words if w not in TITLES] or words
        if not words or len(words) > 4:
            return []
        scored = [(p, self._exact(words, parts)) for p, parts in self.people]
        if not any(x for _, x in scored):  # slips are looked for only where no form fits exactly
            scored = [(p, self._near(words, parts)) for p, parts in self.people]
        top = max((x for _, x in scored), default=0)
        return [(p, x) for p, x in scored if x == top] if top > 0 else []

    @staticmethod
    def _exact(words: list[str], parts: list[str]) -> float:
        """The whole name in either order, one part of it, or a part with initials."""
        if words == parts or words == parts[::-1] or "".join(words) == "".join(parts):
            return 5.0
        if len(words) == 1:
            return 4.0 if words[0] in parts else 0.0
        if len(words) == len(parts):
            for order in (parts, parts[::-1]):
                pairs = list(zip(words, order))
                if all(w == p or (len(w) == 1 and p[0] == w) for w, p in pairs) and any(len(w) > 1 for w, _ in pairs):
                    return 4.0
        return 0.0

    @staticmethod
    def _near(words: list[str], parts: list[str]) -> float:
        """A whole name with at most two slips, or one part of at least five letters with one."""
        if len(words) == 1:
            w = words[0]
            near = min(slips(w, "".join(parts)), slips(w, "".join(parts[::-1])))
            if near <= 2 and len(w) > 7:
                return 3.0 - near
            return 1.0 if len(w) >= 5 and min(slips(w, p, 1) for p in parts) == 1 else 0.0
        near = min(slips(" ".join(words), " ".join(parts)), slips(" ".join(words), " ".join(parts[::-1])))
        return 3.0 - near if near <= 2 else 0.0


def clean_cue(text: str, people: People) -> tuple[list[tuple[str, float]], str]:
    """The readings of the label at the head of a cue, and its speech without labels, times, mark-up, sounds and hesitations."""
    s = html.unescape(text).replace(" ", " ")
    readings: list[tuple[str, float]] = []
    while s:
        m = HEAD_TIME.match(s) or HEAD_MARK.match(s)
        if m and m.end():
            s = s[m.end() :]
            continue
        m = VOICE.match(s)
        if m:
            readings = readings or people.read(m[1])
            s = s[m.end() :]
            continue
        m = BRACKET.match(s) or COLON.match(s)
        if m and (got := people.read(m[1])):
            readings = readings or got
            s = s[m.end() :]
            continue
        m = SOUND.match(s.lstrip())
        if m:
            s = s.lstrip()[m.end() :]
            continue
        break
    if not s.replace(" ", "").isalpha():  # a pattern is tried only where its signs occur
        if "<" in s:
            s = TAG.sub("", s)
        if "♪" in s or "♫" in s:
            s = SUNG.sub(" ", s)
        if "[" in s or "(" in s or "*" in s or "{" in s:
            s = SOUND.sub(" ", s)
        if ":" in s:
            s = ANY_TIME.sub(" ", s)
        s = MARKS.sub(" ", s)
    if not any(not HESITATION.match(w) for w in WORD.findall(s)):
        return readings, ""
    german = GERMAN.search(s) is not None
    s = (HESITATION_WITH_SIGNS if german else HESITATION_ELSEWHERE).sub("", s)
    return readings, re.sub(r"\s+", " ", s).strip(" -–—")


#: A partition's cases travel as a few Arrow blocks, so that the passes over them don't convert them row by row.
BLOCKS = "pid int, block binary"
_CASES = [("pid", "int32"), ("video_id", "string"), ("start_s", "float64"), ("seg_id", "int64"), ("end_s", "float64"), ("named", "string"), ("readings", None), ("lower", "bool_"), ("stops", "bool_"), ("speech", "string")]


def _pack(rows: list[tuple]) -> pd.DataFrame:
    """Cases as one block."""
    import pyarrow as pa

    kinds = [getattr(pa, kind)() if kind else pa.list_(pa.struct([("s", pa.string()), ("x", pa.float64())])) for _, kind in _CASES]
    arrays = [pa.array(column, kind, from_pandas=True) for column, kind in zip(zip(*rows), kinds)]
    batch = pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in _CASES])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return pd.DataFrame({"pid": [rows[0][0]], "block": [sink.getvalue().to_pybytes()]})


def _unpack(blocks) -> pd.DataFrame:
    import pyarrow as pa

    return pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in blocks]).to_pandas()


def speech_cases(segments: DataFrame, people: list[tuple], with_text: bool, partitions: int) -> DataFrame:
    """The cases of a table of cues in blocks, range-sorted by video, start and seg_id, checkpointed with their partition number ``pid``.

    One row per cue with a video, a finite start and at least one spoken word, whatever its kind. ``named`` is the one reading of
    its label; ``readings`` has them where there are several. The raw cues are sorted, so that each is cleaned once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, before = People(people), None
        for pdf in batches:
            out = []
            for pid, seg, video, start, end, text, label in zip(pdf["pid"], pdf["seg_id"], pdf["video_id"], pdf["start_s"], pdf["end_s"], pdf["text"], pdf["speaker"]):
                if before == (seg, video):  # a repeated row
                    continue
                before = (seg, video)
                head, speech = clean_cue(text, known)
                if not speech:
                    continue
                readings = known.read(label) or head
                several = [{"s": s, "x": x} for s, x in readings] if len(readings) > 1 else None
                out.append((pid, video, start, seg, end, readings[0][0] if len(readings) == 1 else None, several, speech[:1].islower(), speech[-1:] in ".!?…", speech if with_text else None))
            if out:
                yield _pack(out)

    start = F.col("start_s").cast("double")
    use = F.col("seg_id").isNotNull() & F.col("video_id").isNotNull() & F.col("text").isNotNull() & start.isNotNull() & ~F.isnan(start) & (F.abs(start) < float("inf"))
    rows = segments.where(use).select("seg_id", "video_id", start.alias("start_s"), F.col("end_s").cast("double").alias("end_s"), "text", "speaker")
    keys = ["video_id", "start_s", "seg_id"]
    ranged = rows.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys).withColumn("pid", F.spark_partition_id())
    return materialize(ranged.mapInPandas(run, BLOCKS))


#: Pairs of a labelled case and the one before it that the model is fitted on, at most; cases that a partition looks at beyond
#: its own on either side, at most.
PAIRS, HISTORY = 20_000, 64
#: Weights of a change before anything is fitted: constant, pause (per second, up to 2), break of continuity, log length.
PRIOR = (-1.0, 0.8, 0.5, 0.2)


def _evidence(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The pause before every case (0 to 2 s) and whether lexical continuity breaks there."""
    start, end = pdf["start_s"].to_numpy(np.float64), pdf["end_s"].to_numpy(np.float64)
    gap = np.append(0.0, start[1:] - end[:-1])
    pauses = np.clip(np.nan_to_num(gap, nan=0.0, posinf=0.0, neginf=0.0), 0, 2)
    return pauses, np.append(True, pdf["stops"].to_numpy(bool)[:-1]) & ~pdf["lower"].to_numpy(bool)


def _pairs(most: int):
    """Of every partition, up to ``most`` pairs of neighbouring labelled cases of a video: features, and whether the speaker changes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = most
        for block in batches:
            if left <= 0 or not len(block):
                continue
            pdf = _unpack(block["block"])
            pauses, breaks = _evidence(pdf)
            labelled = np.flatnonzero(pdf["named"].notna().to_numpy())
            if len(labelled) < 2:
                continue
            video, named = pdf["video_id"].to_numpy(object)[labelled], pdf["named"].to_numpy(object)[labelled]
            same = video[1:] == video[:-1]
            change = named[1:] != named[:-1]
            run_start = np.maximum.accumulate(np.where(np.append(True, change | ~same), labelled, 0))
            length = labelled[1:] - run_start[:-1]
            at = np.flatnonzero(same)[:left]
            left -= len(at)
            yield pd.DataFrame({"pause": pauses[labelled[1:]][at], "broken": breaks[labelled[1:]][at].astype(float), "length": np.log1p(length[at].astype(float)), "change": change[at].astype(float)})

    return run


def fit_changes(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Logistic weights of a change by Newton steps, drawn towards PRIOR, which they equal without rows."""
    prior = np.array(PRIOR)
    w, x = prior.copy(), np.column_stack([np.ones(len(x)), x]) if len(x) else np.zeros((0, len(prior)))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * (w - prior))
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def choose_readings(readings: list[list], pauses: np.ndarray, breaks: np.ndarray, weights: np.ndarray | tuple = PRIOR) -> list[str | None]:
    """The speaker that every case names under the best segmentation into turns, None where it names nobody.

    Forward scores over the labelled cases: a state is a reading of the label with the number of cases that its turn has so far on
    the best path to it; it goes on with the turn or opens one. Back pointers give the segmentation of the best last state.
    """
    out: list[str | None] = [None] * len(readings)
    w0, w_pause, w_break, w_length = weights
    state: dict[str, tuple[float, int]] = {}
    back: list[dict[str, str | None]] = []
    at = [i for i, r in enumerate(readings) if r is not None and len(r)]
    stays: dict[int, float] = {}
    for i in at:
        base = w0 + w_pause * pauses[i] + w_break * breaks[i]
        now, links = {}, {}
        for r in readings[i]:
            who, best, opened, source = r["s"], None, i, None
            for k, (score, since) in state.items():
                z = max(-30.0, min(30.0, base + w_length * log1p(i - since)))
                # log p(change) for another speaker, log p(no change) for the same
                v = score - (log1p(exp(-z)) if k != who else log1p(exp(z)))
                if best is None or v > best:
                    best, opened, source = v, since if k == who else i, k
            now[who], links[who] = ((best or 0.0) + r["x"], opened), source
        state = now
        back.append(links)
    last = max(sorted(state), key=lambda k: state[k][0]) if state else None
    for i, links in zip(reversed(at), reversed(back)):
        out[i] = last
        last = links[last]
    return out


def _whole(batches: Iterator[pd.DataFrame]) -> pd.DataFrame | None:
    parts = [b for p in batches for b in p["block"]]
    return _unpack(parts) if parts else None


def _readings(pdf: pd.DataFrame) -> list[list]:
    """Every case's readings; a label with one reading has the full score."""
    return [[{"s": n, "x": 5.0}] if isinstance(n, str) else [{"s": x["s"], "x": x["x"]} for x in r] if r is not None else [] for n, r in zip(pdf["named"], pdf["readings"])]


def _rim(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The labelled cases of a partition's first video up to the first of one reading, and of its last video from the last such one on."""
    pdf = _whole(batches)
    if pdf is None:
        return
    pauses, breaks = _evidence(pdf)
    video, labelled = pdf["video_id"].to_numpy(object), (pdf["named"].notna() | pdf["readings"].notna()).to_numpy()
    sure = pdf["named"].notna().to_numpy()
    for side, name in (("head", video[0]), ("tail", video[-1])):
        at = np.flatnonzero(labelled & (video == name))
        order = at if side == "head" else at[::-1]
        until = np.flatnonzero(sure[order])
        kept = np.sort(order[: min(HISTORY, int(until[0]) + 1 if len(until) else len(order))])
        rows = _readings(pdf.iloc[kept])
        yield pd.DataFrame([(int(pdf["pid"].iloc[0]), side, name, bool(len(until)), [[{"s": x["s"], "x": x["x"]} for x in r] for r in rows], pauses[kept].tolist(), breaks[kept].tolist())], columns=["pid", "side", "video", "closed", "readings", "pauses", "breaks"])


RIM = "pid int, side string, video string, closed boolean, readings array<array<struct<s:string,x:double>>>, pauses array<double>, breaks array<boolean>"


def surroundings(rims: list) -> dict[int, tuple[list, list]]:
    """pid -> the labelled cases before and behind its own that settle its readings, as (readings, pause, break) triples."""
    by = {}
    for r in rims:
        triples = list(zip([[x.asDict() if hasattr(x, "asDict") else dict(x) for x in one] for one in r["readings"]], r["pauses"], r["breaks"]))
        by.setdefault(r["pid"], {})[r["side"]] = (r["video"], r["closed"], triples)
    pids = sorted(by)
    before, behind = {}, {}
    carried: tuple = (None, [])
    for p in pids:
        video, _, _ = by[p]["head"]
        before[p] = carried[1] if carried[0] == video else []
        last, closed, rows = by[p]["tail"]
        carried = (last, rows if closed or carried[0] != last else (carried[1] + rows)[-HISTORY:])
    carried = (None, [])
    for p in reversed(pids):
        video, _, _ = by[p]["tail"]
        behind[p] = carried[1] if carried[0] == video else []
        first, closed, rows = by[p]["head"]
        carried = (first, rows if closed or carried[0] != first else (rows + carried[1])[:HISTORY])
    return {p: (before[p], behind[p]) for p in pids}


def _decoder(around: dict[int, tuple[list, list]], weights: np.ndarray):
    """Adds the named speaker of every case to a sorted partition."""

    def named(batches: Iterator[pd.DataFrame]) -> pd.DataFrame | None:
        pdf = _whole(batches)
        if pdf is None:
            return None
        before, behind = around[int(pdf["pid"].iloc[0])]
        readings, (pauses, breaks) = _readings(pdf), _evidence(pdf)
        speaker, video = np.empty(len(pdf), object), pdf["video_id"].to_numpy(object)
        cuts = [0, *(np.flatnonzero(video[1:] != video[:-1]) + 1).tolist(), len(pdf)]
        for a, b in zip(cuts, cuts[1:]):
            first, last = before if a == 0 else [], behind if b == len(pdf) else []
            r = [x[0] for x in first] + readings[a:b] + [x[0] for x in last]
            more = lambda own, i: [x[i] for x in first] + own[a:b].tolist() + [x[i] for x in last]  # noqa: E731, B023
            speaker[a:b] = choose_readings(r, more(pauses, 1), more(breaks, 2), weights)[len(first) : len(first) + b - a]
        pdf["speaker_id"] = speaker
        return pdf

    return named


def _summary(named):
    """One row per partition: what it does to the open turn of its last video."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = named(batches)
        if pdf is None:
            return
        tail = pdf[pdf["video_id"] == pdf["video_id"].iloc[-1]]
        spoken = tail.dropna(subset=["speaker_id"])
        first, last, opened, one_run = None, None, None, True
        if len(spoken):
            speakers = spoken["speaker_id"].to_numpy(object)
            first, last = speakers[0], speakers[-1]
            changes = np.flatnonzero(speakers[1:] != speakers[:-1])
            one_run = not len(changes)
            opened = int(spoken["seg_id"].iloc[0 if one_run else changes[-1] + 1])
        yield pd.DataFrame(
            [(int(pdf["pid"].iloc[0]), pdf["video_id"].iloc[0], tail["video_id"].iloc[0], int(tail["seg_id"].iloc[0]), first, last, opened, one_run)],
            columns=["pid", "first_video", "video", "first_seg", "first", "last", "opened", "one_run"],
        )

    return run


def carry_turns(summaries: list[tuple]) -> dict[int, tuple | None]:
    """Prefix-combination of the summaries: pid -> the open turn (video, speaker, turn's first case) its partition goes on with."""
    out, state = {}, None
    for pid, first_video, video, first_seg, first, last, opened, one_run in sorted(summaries, key=lambda r: r[0]):
        out[pid] = state if state and state[0] == first_video else None
        if state and state[0] == video:
            if last is not None and not (one_run and last == state[1]):
                state = (video, last, opened)
        else:
            # Cases before the first label of a video form a turn of nobody.
            state = (video, last, opened if last is not None else first_seg)
    return out


def turn_cases(segments: DataFrame, speakers: DataFrame, with_text: bool = False, partitions: int | None = None) -> DataFrame:
    """``video_id, start_s, end_s, seg_id, turn_seg_id, speaker_id, speech`` of every case, in order within a turn by start_s, seg_id.

    Repeated rows of a seg_id count once. Cues without video, start or text are no cases; cases before the first known label of
    a video have a null speaker and form one turn. ``speakers`` is a small fixed table (its rows are checked against 10,000).
    Extra columns are ignored. An empty input gives an empty result.
    """
    people = [tuple(r) for r in speakers.select("speaker_id", "resolved_name", "label").limit(10_001).collect()]
    if len(people) > 10_000:
        raise ValueError("more than 10,000 speakers: match labels by a join instead")
    n = partitions or shuffle_partitions(segments.sparkSession, -(-segments.count() // ROWS))
    ranged = speech_cases(segments, people, with_text, n)
    pairs = ranged.mapInPandas(_pairs(-(-PAIRS // n)), "pause double, broken double, length double, change double").limit(PAIRS).toPandas()
    weights = fit_changes(pairs[["pause", "broken", "length"]].to_numpy(np.float64), pairs["change"].to_numpy(np.float64))
    named = _decoder(surroundings(ranged.mapInPandas(_rim, RIM).collect()), weights)  # two bounded rows per partition
    schema = "pid int, first_video string, video string, first_seg bigint, first string, last string, opened bigint, one_run boolean"
    carry = carry_turns([tuple(r) for r in ranged.mapInPandas(_summary(named), schema).collect()])  # one row per partition

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = named(batches)
        if pdf is None:
            return
        state = carry[int(pdf["pid"].iloc[0])]
        video = pdf["video_id"].to_numpy(object)
        head = np.append(True, video[1:] != video[:-1])
        group = np.cumsum(head)
        speaker = pdf["speaker_id"].copy()
        if state and pd.isna(speaker.iloc[0]):
            speaker.iloc[0] = state[1]
        speaker = speaker.groupby(group).ffill().to_numpy(object)
        blank = pd.isna(speaker)
        speaker[blank] = ""
        opens = head | np.append(True, speaker[1:] != speaker[:-1])
        seg = pdf["seg_id"].to_numpy(np.int64)
        turn = seg[np.maximum.accumulate(np.where(opens, np.arange(len(seg)), 0))]
        if state and speaker[0] == (state[1] or ""):
            until = np.flatnonzero(opens[1:])
            turn[: until[0] + 1 if len(until) else len(turn)] = state[2]
        speaker[blank] = None
        yield pd.DataFrame({"video_id": video, "start_s": pdf["start_s"], "end_s": pdf["end_s"], "seg_id": seg, "turn_seg_id": turn, "speaker_id": speaker, "speech": pdf["speech"]})

    return ranged.mapInPandas(run, "video_id string, start_s double, end_s double, seg_id bigint, turn_seg_id bigint, speaker_id string, speech string")


def speaker_turns(segments: DataFrame, speakers: DataFrame) -> DataFrame:
    """Clean turns: ``video_id, turn_seg_id, speaker_id, start_s, end_s, n_cases, text`` (the cases' speech in order)."""
    cases = turn_cases(segments, speakers, with_text=True)
    part = F.struct("start_s", "seg_id", "speech")
    turns = cases.groupBy("video_id", "turn_seg_id", "speaker_id").agg(
        F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.count(F.lit(1)).alias("n_cases"), F.array_sort(F.collect_list(part)).alias("parts")
    )
    return turns.withColumn("text", F.concat_ws(" ", F.transform("parts", lambda p: p["speech"]))).drop("parts")
