"""The scoring plan: select, pack, call a scorer, match, reconcile, log, archive."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.functions.text import USAGE_LIMIT
from jobweave.operators.batching import RUBRIC, matched, packed, reconciled
from jobweave.operators.lineage import cut_lineage
from jobweave.operators.state import to_archive

ANSWER = "id long, score int, rubric map<string,struct<points:int,note:string>>, reasoning string, error string, position int"
COLUMNS = [c.split(" ")[0] for c in ANSWER.split(", ")]
NAMES = pd.Index(COLUMNS, dtype=object)
Scorer = Callable[[pd.DataFrame], pd.DataFrame]


def keyword_scorer(words: list[str]) -> Scorer:
    """A scorer without a model: the share of the words that a description holds, spread over the parts by weight."""

    def score(batch: pd.DataFrame) -> pd.DataFrame:
        texts = [t.lower() if isinstance(t, str) else "" for t in batch["description"].tolist()]
        share = [sum(w in t for w in words) / max(1, len(words)) for t in texts]
        rows = []
        for place, (job, part) in enumerate(zip(batch["id"].tolist(), share)):
            rubric = {k: {"points": int(w * part), "note": ""} for k, w in RUBRIC.items()}
            rows.append((job, sum(p["points"] for p in rubric.values()), rubric, "words", None, place))
        # One block of objects: a frame of columns takes longer to make than a job to score.
        return pd.DataFrame(np.array(rows, dtype=object).reshape(-1, len(COLUMNS)), columns=NAMES, dtype=object)

    return score


class ProviderError(RuntimeError):
    """What a scorer raises where calling itself failed (an unknown model, an expired login): it would fail for every job alike."""


@dataclass
class Streak:
    """Runs of jobs that failed by the provider's fault, of a stretch of a run: at its start, at its end, the longest, and whether there is anything else in it."""

    first: int = 0
    last: int = 0
    longest: int = 0
    whole: bool = True  # nothing but such failures

    def add(self, provider_failed: bool) -> None:
        self.last = self.last + 1 if provider_failed else 0
        self.whole = self.whole and provider_failed
        self.longest = max(self.longest, self.last)
        self.first = self.last if self.whole else self.first

    def then(self, other: Streak) -> Streak:
        """Both stretches, one behind the other."""
        return Streak(
            self.first + other.first if self.whole else self.first,
            self.last + other.last if other.whole else other.last,
            max(self.longest, other.longest, self.last + other.first),
            self.whole and other.whole,
        )


class Caller:
    """Calls the scorer for batches in order. A batch that fails, and jobs that an answer leaves out, go one by one.

    While nothing is scored (armed), a streak of provider's failures as long as the limit ends the calling: what is left is handed back. Once anything is scored no
    failure ends it but a usage limit, which ends it at once.
    """

    def __init__(self, scorer: Scorer, attempts: int, most_errors: int, armed: bool, streak: Streak | None = None):
        self.scorer, self.attempts, self.most_errors, self.armed = scorer, attempts, most_errors, armed
        self.streak, self.scored, self.limit = streak or Streak(), False, None

    @property
    def tripped(self) -> bool:
        return self.armed and not self.scored and self.streak.last >= self.most_errors

    def tried(self, ids: list, jobs: pd.DataFrame) -> tuple[list[tuple] | None, str | None, bool]:
        """The usable answers (ANSWER) to jobs (id, description); or why there are none, and whether the provider is at fault. Only what the scorer made of an answer is tried again."""
        error = None
        for _ in range(self.attempts):
            try:
                return usable(self.scorer(jobs), ids), None, False
            except Exception as e:  # noqa: BLE001  a scorer may fail in any way
                error = str(e)[:400]
                if re.search(USAGE_LIMIT, error):
                    self.limit = error
                    return None, error, True
                if isinstance(e, ProviderError):
                    return None, error, True
        return None, error, False

    def __call__(self, ids: list, jobs: pd.DataFrame) -> list[tuple]:
        """Answers, failures with their error; jobs that were not called for are left out."""
        answer, error, provider = self.tried(ids, jobs)
        out = list(answer or [])
        had = {a[0] for a in out}
        if out:
            self.scored = True
            self.streak.add(False)
        for k, job in enumerate(ids):
            if job in had:
                continue
            if self.limit:
                out.append(failed(job, self.limit))
                continue
            if self.tripped:
                break
            if len(ids) > 1:
                answer, error, provider = self.tried([job], jobs.iloc[k : k + 1])
            if answer:
                self.scored = True
                out += answer
            else:
                out.append(failed(job, error or "no usable answer"))
            self.streak.add(provider and error is not None)
        return out


def usable(answer: pd.DataFrame, ids: list) -> list[tuple]:
    """Rows (ANSWER) of what was asked for, without an error and with a score. Plain values: a call costs little more than its scorer, as there may be one for each job."""
    asked, out = set(ids), []
    rows = (answer if answer.columns.tolist() == COLUMNS else answer[COLUMNS]).to_numpy(dtype=object).tolist()
    for job, score, rubric, reasoning, error, position in rows:
        if job in asked and missing(error) and not missing(score) and 0 <= score <= 100:
            # Whole numbers stay so where others are missing.
            out.append((job, int(score) if score == int(score) else score, rubric, reasoning, None, position))
    return out


def missing(value) -> bool:
    return value is None or value is pd.NA or value != value


def failed(job, error: str) -> tuple:
    return (job, None, None, None, error, 0)


TOLD = "lane int, batch long, upto long, scored boolean, usage string, first int, last int, longest int, whole boolean"


#: Rows that a task hands on at once.
HANDED = 2_000


def laid(rows: DataFrame, lanes: int) -> DataFrame:
    """rows (lane, batch, id, description) stored once for all epochs: each lane is a partition, in order."""
    return cut_lineage(rows.repartitionById(lanes, F.col("lane")).sortWithinPartitions("lane", "batch", "id"))


def called(rows: DataFrame, scorer: Scorer, attempts: int, most_errors: int, armed: bool, streak: Streak | None) -> DataFrame:
    """ANSWER and `told` (TOLD): answers to rows, and behind those of each lane how far it came (batch, and id within it) and what it met.

    With a streak, all lanes are one stretch in one task, which goes on from the streak and ends as soon as anything is scored or the breaker trips. Without one, lanes are
    stretches of their own, each in a task of its own. rows: lane, batch, id, description, as `laid` has stored them.
    """
    alone = streak is not None
    # All tasks look for the rows of the one stretch; lanes are read as they lie.
    ordered = rows.repartition(1).sortWithinPartitions("lane", "batch", "id") if alone else rows

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[tuple[int, int, list, pd.DataFrame]]:
        """lane, batch, ids, jobs: the last batch of a part may go on in the next."""
        held = None
        for part in parts:
            part = part if held is None else pd.concat([held, part])
            lane, batch, ids, jobs = part["lane"].tolist(), part["batch"].tolist(), part["id"].tolist(), part[["id", "description"]]
            begin = 0
            for k in range(1, len(ids)):
                if batch[k] != batch[begin] or lane[k] != lane[begin]:
                    yield lane[begin], batch[begin], ids[begin:k], jobs.iloc[begin:k]
                    begin = k
            held = part.iloc[begin:]
        if held is not None and len(held):
            yield int(held["lane"].iloc[0]), int(held["batch"].iloc[0]), held["id"].tolist(), held[["id", "description"]]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        caller, lane, place, out = None, None, (-1, -1), []

        def closed() -> tuple:
            s = caller.streak
            return (*failed(None, ""), {"lane": lane, "batch": place[0], "upto": place[1], "scored": caller.scored, "usage": caller.limit, "first": s.first, "last": s.last, "longest": s.longest, "whole": s.whole})

        for own, batch, ids, jobs in batches(parts):
            over = caller is not None and (caller.limit is not None or caller.tripped or (alone and caller.scored))
            if over and (alone or own == lane):
                continue
            if own != lane:
                if caller is not None:
                    out.append(closed())
                lane, place = own, (-1, -1)
                caller = Caller(scorer, attempts, most_errors, armed, (caller.streak if caller else streak) if alone else None)
            got = caller(ids, jobs)
            if got:
                # Jobs are left out only where nothing was scored, so those that were called come first.
                place = batch, max(a[0] for a in got)
                out += [(*a, None) for a in got]
            if len(out) >= HANDED:
                yield handed(out)
                out = []
        if caller is not None:
            out.append(closed())
        if out:
            yield handed(out)

    return cut_lineage(ordered.mapInPandas(run, f"{ANSWER}, told struct<{', '.join(c.replace(' ', ':', 1) for c in TOLD.split(', '))}>"))


def handed(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in zip([*COLUMNS, "told"], zip(*rows))})


def scored(pending: DataFrame, scorer: Scorer, lanes: int = 64, attempts: int = 2, most_errors: int = 3) -> DataFrame:
    """Answers (ANSWER) for postings (id, ingested_at, description), ids unique.

    Jobs go in lanes, packed in order, each batch one call; jobs of a batch that failed, or that its answer leaves out, are called one by one. The run goes in epochs of
    batches, each twice as long as the one before, whose answers are stored before the next begins, so no job is paid for twice. The breaker is shared by all lanes through them: the
    first epoch is one stretch, which ends with the first score; `most_errors` provider's failures (ProviderError) in a row before anything is scored end the
    run. If the first epoch scores nothing without tripping, lanes go on side by side, each handing back what it left when it trips by itself, and their streaks are joined in
    order. Once anything is scored no job is lost to the breaker. A usage limit ends its lane at once and the run after the epoch. Jobs that are not called for carry the reason.
    """
    sized = pending.select("id", "description", F.pmod("id", F.lit(lanes)).cast("int").alias("lane"), F.length("description").alias("size"))
    batches = packed(sized.select("lane", "id", "size"), "lane", "id", "size")
    rows = laid(sized.join(batches.select("id", "batch"), "id").select("lane", "batch", "id", "description"), lanes)
    last = rows.agg(F.max("batch").alias("b")).first()["b"]
    answer = COLUMNS
    out, done, streak, armed, upto = [], {}, Streak(), True, 1
    stop = None

    def left() -> DataFrame:
        """Rows behind where their lane came to: a comparison with at most `lanes` places."""
        if not done:
            return rows
        at = F.create_map(*[F.lit(x) for lane, place in done.items() for x in (lane, F.struct(F.lit(place[0]).cast("long").alias("batch"), F.lit(place[1]).cast("long").alias("id")))])
        place = F.element_at(at, F.col("lane"))
        return rows.where(place.isNull() | (F.struct("batch", "id") > place))

    while last is not None:
        alone = armed and not out
        part = called(left().where(F.col("batch") < upto), scorer, attempts, most_errors, armed, Streak() if alone else None)
        out.append(part.where("told is null").select(*answer))
        told = sorted((r["told"] for r in part.where("told is not null").select("told").collect()), key=lambda t: t["lane"])
        done |= {t["lane"]: (t["batch"], t["upto"]) for t in told if t["batch"] >= 0}
        stop = next((t["usage"] for t in told if t["usage"]), None)
        if armed and any(t["scored"] for t in told):
            armed = False
        elif armed and told:
            for t in told[-1:] if alone else told:
                streak = streak.then(Streak(t["first"], t["last"], t["longest"], t["whole"]))
            if streak.longest >= most_errors:
                stop = stop or f"stopped after {most_errors} provider failures in a row with nothing scored"
        if stop or (upto > last and left().isEmpty()):
            break
        upto = min(upto * 2, last + 1) if upto <= last else upto
    if stop:
        rest = left().select("id", F.lit(stop).alias("error"))
        kinds = dict(pair.split(" ", 1) for pair in ANSWER.split(", "))
        out.append(rest.select(*[F.col(c) if c in ("id", "error") else F.lit(0 if c == "position" else None).cast(kinds[c]).alias(c) for c in answer]))
    if not out:
        return pending.sparkSession.createDataFrame([], ANSWER)
    total = out[0]
    for more in out[1:]:
        total = total.unionByName(more)
    # Epochs by lanes are many small partitions.
    return total.coalesce(lanes)


def results(pending: DataFrame, answers: DataFrame, status: Column | None = None) -> DataFrame:
    """pending with answer, score (reconciled with its parts) and archive (low scores of what nobody has looked at)."""
    out = matched(pending, answers, "id", "position")
    parts = [F.col("answer.rubric")[k]["points"] for k in RUBRIC]
    score = reconciled(F.col("answer.score"), parts)
    return out.withColumn("score", score).withColumn("archive", to_archive(F.col("score"), status if status is not None else F.lit(None).cast("string")))
