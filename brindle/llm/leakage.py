"""Evaluation texts leaking into a corpus: latent semantic retrieval and exact checks.

1. Corpus texts are cut into overlapping passages over the vocabulary of the
   evaluation texts; a run of evaluation words always lies in one passage whole.
2. TF-IDF weights use passage counts over the whole corpus. A randomised SVD of all
   passages, those of the corpus and those of the evaluation texts, is computed by
   distributed passes: every task adds up its part of ``A'A X``.
3. In the latent space, one for all evaluation texts, every passage is compared with the
   windows of the evaluation texts, some texts at a time; pairs above a cosine are
   candidates. So is every pair that shares the hash of a whole run, whatever its cosine:
   no run depends on the latent space.
4. Candidates are checked on the words themselves: longest common run, longest common
   subsequence, and the answer in the text.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.session import cut_lineage, spread

#: Languages written without blanks: runs are counted in letters, not in words.
UNSPACED = ("zh", "ja", "th")
RUN_WORDS, RUN_LETTERS = 12, 20
#: Passages: width and step in positions; a step is a run, a width two.
WORD_WIDTH, LETTER_WIDTH = 2 * RUN_WORDS, 2 * RUN_LETTERS
#: Letters are compared by overlapping groups of three.
GRAM = 3
#: Evaluation texts that one pass over the corpus is compared with; more are taken in
#: further passes over the same space.
BLOCK_ITEMS = 2000
RANK = 128
#: Rows of sums added by one task, and bytes of one row.
FAN, SLICE_BYTES = 32, 4 << 20

_WORD = regex.compile(r"[\p{L}\p{N}\p{M}]+")
_INVISIBLE = regex.compile(r"[\p{Cf}͏ᅟᅠ឴឵᠋-᠏︀-️]+")
_UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]")


def words(text: str | None) -> list[str]:
    """Runs of letters and digits in NFKC, case and invisible characters ignored."""
    if not text:
        return []
    plain = _INVISIBLE.sub("", unicodedata.normalize("NFKC", _INVISIBLE.sub("", text)))
    return _WORD.findall(plain.casefold())


def grams(tokens: list[str]) -> list[str]:
    """Overlapping groups of letters and digits, everything between left out."""
    letters = "".join(tokens)
    return [letters[i : i + GRAM] for i in range(len(letters) - GRAM + 1)]


@dataclass(frozen=True)
class Item:
    item_id: int
    unspaced: bool
    terms: tuple[int, ...]
    answer: tuple[str, ...]


@dataclass
class Block:
    """Evaluation texts as sequences over their own vocabulary."""

    items: list[Item]
    vocabulary: dict[str, int]  # words as they are, groups of letters with a leading blank
    letters_everywhere: bool  # whether a run of letters may occur in a text without such a script


def make_block(rows: list[tuple]) -> Block:
    vocabulary: dict[str, int] = {}
    items, everywhere = [], False
    for item_id, lang, prompt, answer in rows:
        unspaced = (lang or "").strip().lower()[:2] in UNSPACED
        tokens = words(prompt)
        if unspaced:
            letters = "".join(tokens)
            everywhere |= any(not _UNSPACED.search(letters[i : i + RUN_LETTERS]) for i in range(len(letters) - RUN_LETTERS + 1))
            tokens = [" " + g for g in grams(tokens)]
        items.append(Item(item_id, unspaced, tuple(vocabulary.setdefault(t, len(vocabulary)) for t in tokens), tuple(words(answer))))
    return Block(items, vocabulary, everywhere)


def shape(unspaced: bool) -> tuple[int, int, int]:
    """Width and step of passages, and the length of a run, in positions."""
    return (LETTER_WIDTH, RUN_LETTERS, RUN_LETTERS - GRAM + 1) if unspaced else (WORD_WIDTH, RUN_WORDS, RUN_WORDS)


def passages(terms: np.ndarray, unspaced: bool) -> list[tuple[int, np.ndarray]]:
    """``(start, known terms)`` of the passages that hold at least half a run of
    evaluation terms; others hold neither a run nor a paraphrase of one."""
    width, step, run = shape(unspaced)
    found = []
    for start in range(0, max(1, len(terms) - step), step):
        part = terms[start : start + width]
        part = part[part >= 0]
        if 2 * len(part) >= run:
            found.append((start, part))
    return found


def known_run(ids: list[int]) -> int:
    """Length of the longest run of known terms."""
    gaps = np.flatnonzero(np.array([-1, *ids, -1]) < 0)
    return int(np.diff(gaps).max()) - 1


def _sequences(block: Block) -> Callable:
    """Texts as sequences of evaluation terms, -1 for other words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = block.vocabulary
        letters = any(i.unspaced for i in block.items)
        spaced = any(not i.unspaced for i in block.items)
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                tokens = words(text)
                if spaced:
                    ids = [known.get(t, -1) for t in tokens]
                    if len(ids) - ids.count(-1) >= RUN_WORDS // 2:
                        rows.append((doc, False, ids))
                if letters and (block.letters_everywhere or _UNSPACED.search(text)):
                    ids = [known.get(" " + g, -1) for g in grams(tokens)]
                    # Without a letter of such a script only a whole run can be shared.
                    if len(ids) - ids.count(-1) >= RUN_LETTERS // 2 and (_UNSPACED.search(text) or known_run(ids) > RUN_LETTERS - GRAM):
                        rows.append((doc, True, ids))
            yield pd.DataFrame(rows, columns=["doc_id", "unspaced", "terms"])

    return run


def _document_counts(size: int) -> Callable:
    """Per task: passages, and passages per term, as one row of bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(size + 1, dtype=np.float64)
        for batch in batches:
            for terms, unspaced in zip(batch["terms"], batch["unspaced"]):
                for _, part in passages(terms, unspaced):
                    counts[np.unique(part)] += 1
                    counts[size] += 1
        for n, part in enumerate(np.array_split(counts, _slices(counts))):
            yield pd.DataFrame({"slice": [n], "part": [part.tobytes()]})

    return run


def _slices(total: np.ndarray) -> int:
    return max(1, min(len(total), total.nbytes // SLICE_BYTES))


def _added(parts: DataFrame, dtype: type = np.float64) -> bytes:
    """Sums of byte rows per slice, added by the executors in a tree: no task adds more
    than ``FAN`` rows of one slice; only the sums reach the driver. Rows may come in less
    than double precision; sums are in double."""

    def adder(dtype: type) -> Callable:
        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            total = np.frombuffer(pdf["part"].iloc[0], dtype=dtype).astype(np.float64)
            for part in pdf["part"].iloc[1:]:
                total += np.frombuffer(part, dtype=dtype)
            return pd.DataFrame({"slice": [pdf["slice"].iloc[0]], "branch": [pdf["branch"].iloc[0] // FAN], "part": [total.tobytes()]})

        return add

    held = parts.rdd.getNumPartitions()
    rows = parts.withColumn("branch", F.floor(F.spark_partition_id() / FAN).cast("int"))
    while True:
        rows = rows.groupBy("slice", "branch").applyInPandas(adder(dtype), "slice int, branch int, part binary")
        dtype = np.float64
        held = -(-held // FAN)
        if held <= 1:
            break
    return b"".join(bytes(r["part"]) for r in rows.orderBy("slice").toLocalIterator())


def _sparse(parts: list[np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit TF-IDF rows: row numbers, terms and weights, ordered by row."""
    sizes = [len(p) for p in parts]
    rows = np.repeat(np.arange(len(parts)), sizes)
    terms = np.concatenate(parts)
    keys, tf = np.unique(rows * len(idf) + terms, return_counts=True)
    rows, terms = keys // len(idf), keys % len(idf)
    weights = tf * idf[terms]
    norms = np.sqrt(np.bincount(rows, weights * weights, minlength=len(parts)))
    return rows, terms, weights / np.maximum(norms[rows], 1e-12)


def _times(rows: np.ndarray, terms: np.ndarray, weights: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``A @ right`` for rows that all occur, in order."""
    return np.add.reduceat(right[terms] * weights[:, None].astype(right.dtype), np.flatnonzero(np.diff(rows, prepend=-1)), axis=0)


def _add_transposed(total: np.ndarray, rows: np.ndarray, terms: np.ndarray, weights: np.ndarray, left: np.ndarray) -> None:
    """``total += A.T @ left``."""
    order = np.argsort(terms, kind="stable")
    sorted_terms = terms[order]
    starts = np.flatnonzero(np.diff(sorted_terms, prepend=-1))
    total[sorted_terms[starts]] += np.add.reduceat(left[rows[order]] * weights[order, None].astype(left.dtype), starts, axis=0)


def _chunks(batches: Iterator[pd.DataFrame], size: int = 1500) -> Iterator[list[tuple]]:
    """``(document, unspaced, start, terms)`` of the passages, some at a time."""
    held: list[tuple] = []
    for batch in batches:
        for doc, unspaced, terms in zip(batch["doc_id"], batch["unspaced"], batch["terms"]):
            for start, part in passages(terms, unspaced):
                held.append((doc, unspaced, start, part, terms))
                if len(held) == size:
                    yield held
                    held = []
    if held:
        yield held


def _gram_product(right: np.ndarray, idf: np.ndarray) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(right.shape, dtype=np.float64)
        for chunk in _chunks(batches):
            sparse = _sparse([c[3] for c in chunk], idf)
            _add_transposed(total, *sparse, _times(*sparse, right))
        for n, part in enumerate(np.array_split(total.astype(np.float32), _slices(total))):
            yield pd.DataFrame({"slice": [n], "part": [part.tobytes()]})

    return run


def item_passages(items: list[Item]) -> tuple[list[np.ndarray], np.ndarray]:
    """Windows over the evaluation texts and the item of each: of one run, a third of a run
    apart, for quotations, and of the width of a passage, half a run apart, for paraphrases."""
    parts, owners = [], []
    for n, item in enumerate(items):
        width, _, run = shape(item.unspaced)
        terms = np.array(item.terms, dtype=np.int64)
        for size, step in ((run, max(1, run // 3)), (width, max(1, run // 2))):
            last = max(0, len(terms) - size)
            for start in sorted({*range(0, last + 1, step), last}):
                if len(part := terms[start : start + size]):
                    parts.append(part)
                    owners.append(n)
    return parts, np.array(owners, dtype=np.int64)


def latent_space(sequences: DataFrame, own: list[np.ndarray], idf: np.ndarray, corpus_passages: float, rank: int) -> np.ndarray:
    """Leading right singular vectors of all passages by a randomised SVD: one power
    step, so two passes over the corpus. Evaluation passages are weighted to count as
    much as the corpus, which is far larger."""
    size = len(idf)
    rank = min(rank, size)
    wide = min(rank + 8, size)
    sparse = _sparse(own, idf)
    share = max(1.0, corpus_passages / len(own))

    def product(right: np.ndarray) -> np.ndarray:
        right = right.astype(np.float32)
        # One partial sum per core: what is added is a multiple of the cores, not of the splits.
        parts = sequences.coalesce(sequences.sparkSession.sparkContext.defaultParallelism).mapInPandas(_gram_product(right, idf), "slice int, part binary")
        total = np.frombuffer(_added(parts, np.float32), dtype=np.float64).reshape(-1, wide).copy() if corpus_passages else np.zeros((size, wide))
        mine = np.zeros((size, wide))
        _add_transposed(mine, *sparse, _times(*sparse, right))
        return total + share * mine

    start, _ = np.linalg.qr(product(np.random.default_rng(20250102).standard_normal((size, wide))))
    again = product(start)
    values, vectors = np.linalg.eigh((lambda t: (t + t.T) / 2)(start.T @ again))
    return (start @ vectors[:, np.argsort(-values)[:rank]]).astype(np.float32)


def longest_run(text: np.ndarray, item: tuple[int, ...]) -> int:
    """Length of the longest common run of terms."""
    places: dict[int, list[int]] = {}
    for n, t in enumerate(item):
        places.setdefault(t, []).append(n)
    best, before = 0, {}
    for t in text.tolist():
        now = {}
        for n in places.get(t, ()):
            now[n] = before.get(n - 1, 0) + 1
            if now[n] > best:
                best = now[n]
        before = now
    return best


def common_subsequence(text: np.ndarray, item: tuple[int, ...]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    masks: dict[int, int] = {}
    for n, t in enumerate(item):
        masks[t] = masks.get(t, 0) | 1 << n
    full = (1 << len(item)) - 1
    row = full
    for t in text.tolist():
        hit = row & masks.get(t, 0)
        row = (row + hit | row - hit) & full
    return len(item) - row.bit_count()


def run_hashes(terms: np.ndarray, run: int) -> np.ndarray:
    """A hash of every run of ``run`` terms, by its start; equal runs have equal hashes."""
    size = max(0, len(terms) - run + 1)
    found = np.zeros(size, dtype=np.uint64)
    for n in range(run):
        found = found * np.uint64(0x9E3779B97F4A7C15) + (terms[n : n + size] + 2).astype(np.uint64)
    return found


def item_runs(items: list[Item], unspaced: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of the items of a kind, sorted, and the item of each."""
    run = shape(unspaced)[2]
    own = [(n, run_hashes(np.array(item.terms, dtype=np.int64), run)) for n, item in enumerate(items) if item.unspaced == unspaced]
    hashes = np.concatenate([np.zeros(0, dtype=np.uint64), *(h for _, h in own)])
    owners = np.concatenate([np.zeros(0, dtype=np.int64), *(np.full(len(h), n) for n, h in own)])
    order = np.argsort(hashes, kind="stable")
    return hashes[order], owners[order]


def shared_runs(terms: np.ndarray, unspaced: bool, runs: tuple[np.ndarray, np.ndarray]) -> dict[int, set[int]]:
    """Items that share a whole run with the text, by the start of the passage that holds it."""
    _, step, run = shape(unspaced)
    hashes, owners = runs
    own = run_hashes(terms, run)
    low, high = np.searchsorted(hashes, own, "left"), np.searchsorted(hashes, own, "right")
    found: dict[int, set[int]] = {}
    for at in np.flatnonzero(high > low):
        # The last passage starts a step before the end of the text or earlier.
        start = min(at // step, (max(1, len(terms) - step) - 1) // step) * step
        found.setdefault(int(start), set()).update(owners[low[at] : high[at]].tolist())
    return found


def _candidates(items: list[Item], basis: np.ndarray, idf: np.ndarray, least: float, least_share: float) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, owners = item_passages(items)
        latent = _times(*_sparse(own, idf), basis)
        latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
        latent = latent.T.copy()
        unspaced_windows = np.array([items[n].unspaced for n in owners])
        runs = {kind: item_runs(items, kind) for kind in (False, True)}
        own_terms = [frozenset(item.terms) for item in items]
        # What an item repeats may be common once more each time.
        repeats = [len(item.terms) - len(own) for item, own in zip(items, own_terms)]
        last, shared = None, {}
        for chunk in _chunks(batches):
            vectors = _times(*_sparse([c[3] for c in chunk], idf), basis)
            vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
            near = vectors @ latent
            kind = np.array([c[1] for c in chunk], dtype=bool)
            chosen: dict[tuple[int, int], float] = {}
            at, window = np.nonzero(near >= least)
            same = kind[at] == unspaced_windows[window]
            at, window = at[same], window[same]
            for place, n, cosine in zip(at.tolist(), owners[window].tolist(), near[at, window].tolist()):
                if cosine > chosen.get((place, n), -2):
                    chosen[(place, n)] = cosine
            whole: set[tuple[int, int]] = set()
            for place, (_, unspaced, start, _, terms) in enumerate(chunk):
                if terms is not last:
                    last, shared = terms, shared_runs(np.asarray(terms), unspaced, runs[unspaced])
                for n in shared.get(start, ()):
                    whole.add((place, n))
                    if (place, n) not in chosen:
                        chosen[(place, n)] = float(near[place, owners == n].max())
            rows = []
            near_terms: dict[int, tuple[np.ndarray, frozenset]] = {}
            for (place, n), cosine in chosen.items():
                doc, unspaced, start, _, terms = chunk[place]
                item = items[n]
                width, step, need = shape(unspaced)
                if place not in near_terms:
                    # The passage and the one beside it: a run goes on into it.
                    part = terms[max(0, start - step) : start + width + step]
                    near_terms[place] = part, frozenset(part.tolist())
                around, held = near_terms[place]
                # No more can be common in order than stands in both at all.
                if (place, n) not in whole and len(held & own_terms[n]) + repeats[n] < least_share * len(item.terms):
                    continue
                run_length = longest_run(around, item.terms)
                common = common_subsequence(around, item.terms)
                if common < least_share * len(item.terms) and run_length < need:
                    continue
                extra = GRAM - 1 if unspaced and run_length else 0
                rows.append((doc, item.item_id, cosine, run_length + extra, run_length >= need, common / len(item.terms)))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "cosine", "longest_run", "leaked", "common_share"])

    return run


def leaked_items(documents: DataFrame, items: DataFrame, least: float = 0.6, rank: int = RANK, block_items: int = BLOCK_ITEMS, least_share: float = 0.5) -> DataFrame:
    """Pairs that stand the checks: ``doc_id, item_id, cosine, longest_run, leaked,
    common_share, passages``.

    ``documents`` has ``doc_id, text``; ``items`` has ``item_id, lang, prompt, answer``.
    ``leaked`` says that the text holds a run of at least 12 consecutive words of the
    prompt (20 letters or digits for zh, ja and th); ``longest_run`` is its length within
    the passages around; ``common_share`` is the longest common subsequence of those
    passages as a share of the prompt, which stays high for paraphrases. Candidates that
    hold no whole run and have less than ``least_share`` in common are no pairs; so are told
    apart, before the costly checks, those with too few words in common in any order.

    Null, blank and short texts and prompts give no rows; repeated items of one id count
    once, repeated documents give their pairs once; empty tables give no rows. The items
    are the stated query set: they are read to the driver, and a task holds their
    vocabulary and latent space whole and ``BLOCK_ITEMS`` of them at a time, so neither
    results nor candidates depend on the size of a block. Of the corpus only sums per
    evaluation term reach the driver. Building the result runs the passes of the space.
    """
    spark = documents.sparkSession
    rows = items.select("item_id", "lang", "prompt", "answer").dropna(subset=["item_id", "prompt"]).dropDuplicates(["item_id"]).orderBy("item_id").toLocalIterator()
    asked = make_block([tuple(r) for r in rows])
    asked.items = [i for i in asked.items if i.terms]
    if not asked.items:
        return spark.createDataFrame([], PAIRS + ", passages bigint")
    texts = spread(documents.select("doc_id", "text").filter(F.col("text").isNotNull()), "doc_id")
    # Read by several passes: written once to the shared checkpoint folder.
    sequences = cut_lineage(texts.mapInPandas(_sequences(asked), "doc_id bigint, unspaced boolean, terms array<int>"))
    size = len(asked.vocabulary)
    counted = np.frombuffer(_added(sequences.mapInPandas(_document_counts(size), "slice int, part binary")) or bytes(8 * (size + 1)), dtype=np.float64)
    corpus = float(counted[size])
    idf = np.log(1 + (corpus + 1) / (1 + counted[:size]))
    own, _ = item_passages(asked.items)
    basis = latent_space(sequences, own, idf, corpus, rank)
    blocks = [asked.items[n : n + block_items] for n in range(0, len(asked.items), block_items)]
    found = functools.reduce(DataFrame.unionByName, [sequences.mapInPandas(_candidates(block, basis, idf, least, least_share), PAIRS) for block in blocks])
    return found.groupBy("doc_id", "item_id").agg(
        F.max("cosine").alias("cosine"),
        F.max("longest_run").alias("longest_run"),
        F.max("leaked").alias("leaked"),
        F.max("common_share").alias("common_share"),
        F.count("*").alias("passages"),
    )


PAIRS = "doc_id bigint, item_id bigint, cosine double, longest_run bigint, leaked boolean, common_share double"


def answer_checks(pairs: DataFrame, documents: DataFrame, items: DataFrame) -> DataFrame:
    """Adds ``answer_found``: the answer's words stand in the text in a row. Null answers
    give null. Pairs are few; both sides come by equi joins."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = {}
            hits = []
            for doc, text, answer in zip(batch["doc_id"], batch["text"], batch["answer"]):
                want = " ".join(words(answer))
                if doc not in texts:
                    texts[doc] = " " + " ".join(words(text)) + " "
                hits.append(None if not want else f" {want} " in texts[doc])
            yield batch[["doc_id", "item_id"]].assign(answer_found=pd.Series(hits, dtype=object))

    wide = pairs.select("doc_id", "item_id").join(documents.select("doc_id", "text").dropDuplicates(["doc_id"]), "doc_id").join(items.select("item_id", "answer").dropDuplicates(["item_id"]), "item_id")
    checked = wide.mapInPandas(check, "doc_id bigint, item_id bigint, answer_found boolean")
    return pairs.join(checked, ["doc_id", "item_id"], "left")
