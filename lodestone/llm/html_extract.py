"""HTML extraction: a linear-chain conditional random field over leaf blocks.

A page is cut into leaf blocks (runs of text between block-level tags). Each block has features of its
ancestors (tags, words of class, id and role) and of its text (length, link share, punctuation, place). A
CRF with the states boilerplate and main is trained by maximum likelihood (forward-backward, AdaGrad)
on labelled pages from a grammar (`page_grammar`, TRAINING_PAGES pages, fixed seed); Viterbi decodes
the blocks of a page, and the main ones are joined.

The model has a few hundred weights and is sent with the task. Pages are handled one by one: no
shuffle, nothing kept between pages.

Defined results: null or empty html, or a page without main blocks, gives an empty text and 0 characters;
markup that is cut off or wrongly nested is read as far as it goes; repeated rows are extracted
one by one; extra columns stay out; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import common
from lodestone.llm.html_blocks import Block, leaf_blocks, names_above
from lodestone.llm.page_grammar import LABEL, labelled_pages

TRAINING_PAGES, PASSES, RATE, PENALTY = 1500, 120, 0.5, 1e-4


def features(blocks: list[Block], vocabulary: dict | None = None) -> list[set[str]]:
    """Names of the features of each block; of those above it only such as are in the vocabulary, if there is one."""
    out = []
    for i, b in enumerate(blocks):
        f = {"bias", f"tag {b.tag}", *names_above(b.node, vocabulary)}
        n = len(b.text)
        f.add(f"length {min(n.bit_length(), 10)}")
        share = b.linked / max(n, 1)
        f.add("links most" if share > 0.7 else "links some" if share > 0.2 else "links none")
        if "©" in b.text:
            f.add("copyright")
        if b.text[-1] in ".!?":
            f.add("sentence end")
        if i == 0:
            f.add("first")
        if i == len(blocks) - 1:
            f.add("last")
        out.append(f)
    return out


class Model:
    """Weights by feature name (two states), transitions and starts."""

    def __init__(self, weights: dict[str, tuple[float, float]], moves: list[list[float]], starts: list[float]):
        self.weights, self.moves, self.starts = weights, moves, starts

    def decode(self, blocks: list[Block]) -> list[bool]:
        """Viterbi: which blocks are main."""
        (m00, m01), (m10, m11) = self.moves
        back, s0, s1, known = [], 0.0, 0.0, self.weights
        for i, found in enumerate(features(blocks, known)):
            e0 = e1 = 0.0
            for name in found:
                w = known.get(name)
                if w:
                    e0 += w[0]
                    e1 += w[1]
            if i == 0:
                s0, s1 = self.starts[0] + e0, self.starts[1] + e1
                continue
            a, b, c, d = s0 + m00, s1 + m10, s0 + m01, s1 + m11
            back.append((b > a, d > c))
            s0, s1 = max(a, b) + e0, max(c, d) + e1
        if not blocks:
            return []
        state = s1 > s0
        out = [state]
        for pair in reversed(back):
            state = pair[state]
            out.append(state)
        return [bool(x) for x in out[::-1]]


def train(pages: list[str], passes: int = PASSES, rate: float = RATE, penalty: float = PENALTY) -> Model:
    """Fit to pages whose main blocks begin with LABEL."""
    seqs, gold, names = [], [], {}
    for page in pages:
        blocks = leaf_blocks(page)
        if not blocks:
            continue
        y = [b.text.startswith(LABEL) for b in blocks]
        for b in blocks:
            b.text = b.text.removeprefix(LABEL) or "."
        found = features(blocks)
        for f in found:
            for name in f:
                names.setdefault(name, len(names))
        seqs.append(found)
        gold.append(y)
    sizes = [len(y) for y in gold]
    longest, n = max(sizes), len(sizes)
    x = np.zeros((n, longest, len(names)), np.float32)
    y = np.zeros((n, longest), np.int64)
    live = np.zeros((n, longest), bool)
    for i, (found, labels) in enumerate(zip(seqs, gold, strict=True)):
        live[i, : len(labels)] = True
        y[i, : len(labels)] = labels
        for t, f in enumerate(found):
            x[i, t, [names[name] for name in f]] = 1
    flat = x[live]
    w, moves, starts = np.zeros((len(names), 2)), np.zeros((2, 2)), np.zeros(2)
    sums = [np.full_like(v, 1e-8) for v in (w, moves, starts)]
    add = np.logaddexp
    both = live[:, 1:]
    for _ in range(passes):
        e = np.zeros((n, longest, 2))
        e[live] = flat @ w.astype(np.float32)
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = starts + e[:, 0]
        for t in range(1, longest):
            step = add(alpha[:, t - 1, 0, None] + moves[0], alpha[:, t - 1, 1, None] + moves[1]) + e[:, t]
            alpha[:, t] = np.where(live[:, t, None], step, alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            z = beta[:, t + 1] + e[:, t + 1]
            step = add(moves[:, 0] + z[:, 0, None], moves[:, 1] + z[:, 1, None])
            beta[:, t] = np.where(live[:, t + 1, None], step, 0)
        total = add(alpha[:, -1, 0], alpha[:, -1, 1])
        p = np.exp(alpha + beta - total[:, None, None])
        truth = np.eye(2)[y]
        pair = np.exp(alpha[:, :-1, :, None] + moves + (e + beta)[:, 1:, None, :] - total[:, None, None, None])[both]
        real = (truth[:, :-1, :, None] * truth[:, 1:, None, :])[both]
        grads = (flat.T @ (truth - p)[live].astype(np.float32) / n - penalty * w, (real - pair).sum(0) / n, (truth - p)[:, 0].mean(0))
        for v, s, g in zip((w, moves, starts), sums, grads, strict=True):
            s += g * g
            v += rate * g / np.sqrt(s)
    return Model({name: (float(w[i, 0]), float(w[i, 1])) for name, i in names.items()}, moves.tolist(), starts.tolist())


@lru_cache(maxsize=1)
def model() -> Model:
    return train(labelled_pages(TRAINING_PAGES))


def main_text(html: str | None, crf: Model) -> str:
    blocks = leaf_blocks(html) if html else []
    return "\n".join(b.text for b, keep in zip(blocks, crf.decode(blocks), strict=True) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", crf: Model | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html"))
    crf = crf or model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = [main_text(h, crf) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_pydict({"page_id": part.column("page_id"), "url": part.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op5_crf_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))


QUERIES = {"op5_crf_blocks": op5_crf_blocks}
ORACLES: dict[str, str] = {}
