"""Running best k per query inside one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd


class RunningTop:
    """Holds at most k (score, id) pairs per query; equal scores go by id."""

    def __init__(self, qids: np.ndarray, k: int):
        self.qids, self.k = qids, k
        self.held: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(qids)

    def offer(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        held = self.held[q]
        keep = ~np.isnan(scores)
        if held is not None and len(held[0]) >= self.k:
            keep &= scores >= held[1][-1]
        if not keep.any():
            return
        ids, scores = ids[keep], scores[keep]
        if held is not None:
            ids, scores = np.concatenate([held[0], ids]), np.concatenate([held[1], scores])
        if len(scores) > self.k:
            # keep every row that ties with the k-th, the sort below decides by id
            kth = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            near = scores >= kth
            ids, scores = ids[near], scores[near]
        order = np.lexsort((ids, -scores))[: self.k]
        self.held[q] = (ids[order], scores[order])

    def frames(self, score_name: str, queries_per_frame: int = 256) -> Iterator[pd.DataFrame]:
        for start in range(0, len(self.qids), queries_per_frame):
            parts = [
                pd.DataFrame({"qid": self.qids[q], "grant_id": h[0], score_name: h[1]})
                for q, h in enumerate(self.held[start : start + queries_per_frame], start)
                if h is not None
            ]
            if parts:
                yield pd.concat(parts, ignore_index=True)
