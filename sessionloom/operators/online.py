"""Online thread assignment without a model: leaves are placed one after another, in batches.

The rule is sequential by definition: a batch is scored against the threads known before it.  The
leaf texts are prepared as columns; each session then streams through one task as Arrow batches, and
only the open threads are kept in memory, never the session's rows.  Sessions run in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.functions import text

# Fixed values of the scoring rule.
WEIGHTS = {"similarity": 3.0, "apps": 0.8, "entities": 0.8, "anchors": 1.2, "recent": 0.35}
ACCEPT = 1.9
SHORT_LEAF = 3
MAX_ANCHORS = 5
MAX_OCR = 6
MAX_SAMPLES = 6

OUTPUT = "session_id string, leaf_idx bigint, provisional_root_id string, rule string"


def prepare(leaves: DataFrame) -> DataFrame:
    """Leaf columns the assignment needs, all computed in Spark expressions."""
    leaf = {c: F.col(c) for c in leaves.columns}
    objective, summary, entities, ocr = leaf["objective"], leaf["procedure_summary"], leaf["entities"], leaf["ocr_texts"]
    told = F.when(text.filled(summary), summary).otherwise(objective)
    norms = lambda items: F.array_distinct(F.filter(F.transform(items, text.normalize), lambda x: x != ""))
    deliverable = text.deliverable(entities, objective)
    criterion = text.success_criterion(entities, objective, ocr)
    return leaves.select(
        "session_id", "leaf_idx", "num_actions", "objective",
        text.normalize(text.leaf_profile(leaf)).alias("profile"),
        norms(leaf["apps_used"]).alias("app_norms"),
        norms(entities).alias("entity_norms"),
        norms(text.infer_anchors(objective, summary, entities, ocr, 5)).alias("anchor_norms"),
        text.infer_anchors(objective, summary, entities, ocr, 3).alias("anchors"),
        "apps_used", "entities",
        F.transform(ocr, lambda t: text.truncate(t, 240)).alias("ocr_texts"),
        text.truncate(objective, 90).alias("label"),
        text.limit_sentences(objective, 1, 180).alias("short_objective"),
        text.limit_sentences(deliverable, 1, 220).alias("deliverable"),
        text.limit_sentences(criterion, 1, 260).alias("criterion"),
        text.limit_sentences(F.concat(objective, F.lit(". "), told), 2, 320).alias("summary"),
        text.limit_sentences(told, 1, 180).alias("latest"),
    )


def _norm(value: str) -> str:
    return " ".join(value.split()).lower()


def _extend(target: list[str], items, limit: int | None = None) -> None:
    for item in items:
        if item and item not in target and (limit is None or len(target) < limit):
            target.append(item)


def _spread(items: list[str], keep: int) -> list[str]:
    """Evenly spaced items, made up from the front where two share a normalized text."""
    if len(items) <= keep:
        return items
    chosen: dict[str, str] = {}
    places = [round(i * (len(items) - 1) / (keep - 1)) for i in range(keep)]
    for place in [*places, *range(len(items))]:
        if len(chosen) < keep:
            chosen.setdefault(_norm(items[place]), items[place])
    return list(chosen.values())


@dataclass
class Thread:
    """State of one open thread."""

    root_id: str
    wording: dict[str, str] = field(default_factory=dict)
    last_update: str = ""
    anchors: list[str] = field(default_factory=list)
    apps: list[str] = field(default_factory=list)
    entities: list[str] = field(default_factory=list)
    ocr: list[str] = field(default_factory=list)
    objectives: list[str] = field(default_factory=list)
    matcher: SequenceMatcher | None = None
    norms: tuple[set, set, set] = (set(), set(), set())

    def add(self, leaf) -> None:
        _extend(self.apps, leaf.apps_used)
        _extend(self.entities, leaf.entities)
        _extend(self.ocr, leaf.ocr_texts, MAX_OCR)
        _extend(self.objectives, [leaf.objective.strip()])

    def refresh(self, leaf) -> None:
        """Take the wording of the batch's last leaf once; later only the latest step and anchors change."""
        if not self.wording:
            self.wording = {k: getattr(leaf, k) for k in ("label", "short_objective", "deliverable", "criterion", "summary")}
        self.last_update = leaf.latest or self.last_update
        _extend(self.anchors, leaf.anchors, MAX_ANCHORS)

    def freeze(self) -> None:
        """Comparison text and sets used for the next batch."""
        w = self.wording
        lines = [
            ("label", w["label"]), ("objective", w["short_objective"]), ("deliverable", w["deliverable"]),
            ("success_criteria", w["criterion"]), ("summary", w["summary"]), ("last_update", self.last_update),
            ("anchor", ", ".join(self.anchors)), ("apps_used", ", ".join(self.apps)), ("entities", ", ".join(self.entities)),
            ("ocr_text", " | ".join(self.ocr[:3])), ("sample_leaf_objectives", " | ".join(_spread(self.objectives, MAX_SAMPLES))),
        ]
        self.matcher = SequenceMatcher(None, "", _norm("\n".join(f"{name}: {value}" for name, value in lines)))
        self.norms = tuple({_norm(x) for x in items} - {""} for items in (self.apps, self.entities, self.anchors))

    def score(self, leaf, recent: bool, floor: float) -> float:
        """Score against the frozen state; stops early when the bound cannot reach ``floor``."""
        base = sum(
            WEIGHTS[name] * len(own.intersection(theirs))
            for name, own, theirs in zip(("apps", "entities", "anchors"), self.norms, (leaf.app_norms, leaf.entity_norms, leaf.anchor_norms))
        )
        base += WEIGHTS["recent"] if recent else 0.0
        matcher = self.matcher
        matcher.set_seq1(leaf.profile)
        for bound in (matcher.real_quick_ratio, matcher.quick_ratio):
            if WEIGHTS["similarity"] * bound() + base < floor - 1e-9:
                return 0.0
        return WEIGHTS["similarity"] * matcher.ratio() + base


class SessionState:
    """Threads of one session and the batch being placed."""

    def __init__(self, batch_size: int) -> None:
        self.batch_size = batch_size
        self.threads: dict[str, Thread] = {}
        self.recent: str | None = None
        self.opened: dict[str, Thread] = {}
        self.last_leaf: dict[str, object] = {}
        self.in_batch = 0

    def place(self, leaf) -> tuple[str, str]:
        best, best_score = None, 0.0
        for root_id, thread in self.threads.items():
            score = thread.score(leaf, root_id == self.recent, max(best_score, ACCEPT))
            if score > best_score:
                best, best_score = root_id, score
        if best is not None and best_score >= ACCEPT:
            root_id, rule = best, "score"
        elif self.recent is not None and leaf.num_actions <= SHORT_LEAF:
            root_id, rule = self.recent, "recent"
        else:
            root_id, rule = f"R{len(self.threads) + len(self.opened) + 1:03d}", "new"
            self.opened[root_id] = Thread(root_id)
        (self.opened.get(root_id) or self.threads[root_id]).add(leaf)
        self.last_leaf[root_id] = leaf
        self.recent = root_id
        self.in_batch += 1
        if self.in_batch == self.batch_size:
            self.close_batch()
        return root_id, rule

    def close_batch(self) -> None:
        self.threads.update(self.opened)
        for root_id, leaf in self.last_leaf.items():
            self.threads[root_id].refresh(leaf)
            self.threads[root_id].freeze()
        self.opened, self.last_leaf, self.in_batch = {}, {}, 0


def assign_threads(leaves: DataFrame, batch_size: int = 15) -> DataFrame:
    """Provisional thread of every leaf and the rule that chose it (score, recent, new)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, state = None, None
        for part in parts:
            placed = []
            for leaf in part.itertuples(index=False):
                if leaf.session_id != session:
                    session, state = leaf.session_id, SessionState(batch_size)
                placed.append((session, leaf.leaf_idx, *state.place(leaf)))
            yield pd.DataFrame(placed, columns=["session_id", "leaf_idx", "provisional_root_id", "rule"])

    ordered = prepare(leaves).repartition("session_id").sortWithinPartitions("session_id", "leaf_idx")
    return ordered.mapInPandas(run, OUTPUT)
