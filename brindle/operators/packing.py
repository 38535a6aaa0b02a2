"""Evidence packs: needs, covering items, excerpts, byte budgets, bounded exploration.

Ranking and reading are DataFrames; a pack is made of the few selected rows of one
query, so what is here works on small lists, per query and without Spark.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import pairwise

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Groups of a pack by the role of a path.
GROUPS = {"entrypoint": "entrypoints", "source": "implementations", "test": "tests", "config": "configs_docs", "doc": "configs_docs", "template": "supporting", "generated": "supporting", "lockfile": "supporting", "other": "supporting"}


@dataclass(frozen=True)
class Need:
    name: str
    subjects: tuple[str, ...]
    required: bool = True


@dataclass
class Item:
    path: str
    role: str
    score: float
    text: str
    spans: list[tuple[int, int]]
    reasons: list[str] = field(default_factory=list)

    @property
    def group(self) -> str:
        return GROUPS.get(self.role, "supporting")


def meets(need: Need, item: Item) -> bool:
    """All subjects of a need stand in path or text, letter case ignored."""
    hay = f"{item.path}\n{item.text}".casefold()
    return all(s.casefold() in hay for s in need.subjects)


def cover(items: list[Item], needs: list[Need], most: int) -> tuple[list[Item], list[Need]]:
    """Items that meet needs: required needs first, each time the item that meets most open
    ones, ties by score and path; then by score until ``most``. Returns items and open needs."""
    chosen: list[Item] = []
    open_needs = list(needs)
    for required in (True, False):
        while len(chosen) < most and (wanted := [n for n in open_needs if n.required == required]):
            rest = [i for i in items if i not in chosen]
            best = max(rest, key=lambda i: (sum(meets(n, i) for n in wanted), i.score, [-ord(c) for c in i.path]), default=None)
            if best is None or not any(meets(n, best) for n in wanted):
                break
            chosen.append(best)
            open_needs = [n for n in open_needs if not meets(n, best)]
    for item in sorted(items, key=lambda i: (-i.score, i.path)):
        if len(chosen) >= most:
            break
        if item not in chosen:
            chosen.append(item)
    return chosen, open_needs


def windows(spans: list[tuple[int, int]], lines: int, around: int = 3) -> list[tuple[int, int]]:
    """Spans with lines around them, within the file; those that touch are one."""
    merged: list[list[int]] = []
    for low, high in sorted((max(1, a - around), min(lines, b + around)) for a, b in spans):
        if merged and low <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], high)
        else:
            merged.append([low, high])
    return [(a, b) for a, b in merged]


def cropped(text: str, most: int) -> str:
    """At most ``most`` bytes of UTF-8, no character cut."""
    return text.encode()[:most].decode(errors="ignore")


def excerpts(item: Item, most_bytes: int, keep: int = 2) -> list[dict]:
    """The first ``keep`` windows of an item, lines taken off their ends until they fit."""
    lines = item.text.splitlines()
    out, left = [], most_bytes
    for low, high in windows(item.spans, len(lines))[:keep]:
        while high >= low and len("\n".join(lines[low - 1 : high]).encode()) > left:
            high -= 1
        if high < low:
            break
        part = "\n".join(lines[low - 1 : high])
        left -= len(part.encode())
        out.append({"start_line": low, "end_line": high, "text": part})
    return out


def pack(items: list[Item], needs: list[Need], most_items: int = 12, most_bytes: int = 16_384, reserve: int = 512) -> dict:
    """A pack within its byte budget: a small reserve for each item first, the rest in
    reading order. ``status`` tells whether all required needs are met."""
    chosen, missing = cover(items, needs, most_items)
    budget = most_bytes
    rows = []
    for n, item in enumerate(chosen):
        later = reserve * (len(chosen) - n - 1)
        parts = excerpts(item, max(0, min(budget, max(reserve, budget - later))))
        used = sum(len(p["text"].encode()) for p in parts)
        budget -= used
        rows.append({"path": item.path, "group": item.group, "score": item.score, "reasons": item.reasons[:4], "excerpts": parts, "bytes": used})
    required = [n for n in missing if n.required]
    met = sum(n.required for n in needs) - len(required)
    return {
        "items": rows,
        "missing": [n.name for n in missing],
        "status": "complete" if not required else "partial" if met or not needs else "insufficient",
        "confidence": round(1 - len(required) / max(1, sum(n.required for n in needs)), 4),
        "next_queries": [" ".join(n.subjects) for n in sorted(missing, key=lambda n: not n.required)][:3],
        "bytes": most_bytes - budget,
    }


def explore(retrieve, needs: list[Need], query: str, rounds: int = 3, most_items: int = 24) -> dict:
    """Retrieval in rounds: what is missing after one is asked for in the next. A round's
    items count only if they meet a need that was open; stops when all are met, nothing
    new is found, or after ``rounds``. ``retrieve`` maps a text to items."""
    items = {i.path: i for i in retrieve(query)}
    asked, stop, n = [query], "rounds", 1
    for n in range(1, rounds + 1):
        _, missing = cover(list(items.values()), needs, most_items)
        if not missing:
            stop = "satisfied"
            break
        probe = next((p for m in missing if (p := " ".join(m.subjects)[:160]) not in asked), None)
        if probe is None:
            stop = "no_probe"
            break
        if n == rounds:
            break
        asked.append(probe)
        gained = {i.path: i for i in retrieve(probe) if i.path not in items and any(meets(m, i) for m in missing)}
        if not gained:
            stop = "no_gain"
            break
        items |= dict(list(gained.items())[: max(0, most_items - len(items))])
    return {"asked": asked, "stop": stop, "rounds": n, "pack": pack(list(items.values()), needs)}


def items_of(selected: DataFrame, files: DataFrame, query_id: int, most: int = 24) -> list[Item]:
    """The selected rows of one query as items; ``files`` has ``path, content``. What comes
    to the driver is at most ``most`` files."""
    from brindle.operators.ranking import file_role

    rows = selected.filter(F.col("query_id") == query_id).orderBy("position").limit(most)
    wide = rows.join(files.select("path", "content").dropDuplicates(["path"]), "path").withColumn("role", file_role(F.col("path"))).orderBy("position")
    return [Item(r["path"], r["role"], 1.0 / r["position"], r["content"] or "", [(r["start_line"] or 1, r["end_line"] or 1)]) for r in wide.collect()]


def traced(stages: list[tuple[str, DataFrame]]) -> list[dict]:
    """Row counts and gains of named stages, each counted once."""
    counts = [(name, df.count()) for name, df in stages]
    steps = [{"stage": counts[0][0], "rows": counts[0][1], "change": 0}] if counts else []
    return steps + [{"stage": b[0], "rows": b[1], "change": b[1] - a[1]} for a, b in pairwise(counts)]
