"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks in page order (``page_blocks``), a bidirectional LSTM reads the whole sequence
(``block_lstm``), and the blocks that it takes for main text are joined. The labeller is trained in numpy on
``PAGES`` invented pages (``training_pages``), on the driver, once per process; it is small and travels with the tasks.
Pages are independent, so the work is one scan without a shuffle, and linear in the length of a page.

Scripts, styles, comments, the head, form fields' choices and other elements that show no text never become
blocks. Everything else is decided by the labeller, block by block; none is cut short.

Defined cases: a NULL or empty page, or one without main text, gives the empty text; an unfinished tag, comment or
raw element at the end takes the rest of the page with it, as in browsers; a NULL id or url stays NULL; repeated rows are
extracted each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyspan.llm.block_lstm import Network, train
from surveyspan.llm.page_blocks import Block, Paths, page_blocks
from surveyspan.llm.training_pages import labelled_page

PAGES = 2400
#: Blocks scored in one go, and remembered element paths, unless a single page has more.
GROUP = 4096
MOST_PATHS = 50_000


@lru_cache(maxsize=2)
def labeller(pages: int = PAGES) -> Network:
    """The trained network; the same on every run."""
    paths = Paths()
    return train([labelled_page(seed, paths) for seed in range(pages)], paths)


class Extractor:
    """Texts of pages, a group at a time."""

    def __init__(self, network: Network) -> None:
        self.network = network
        self._forget()

    def _forget(self) -> None:
        self.paths, self.vectors = Paths(), []

    def _scored(self, group: list[list[Block]]) -> list[str]:
        self.network.path_vectors(self.paths, self.vectors)
        chosen = self.network.probabilities(group, self.vectors)
        texts = [
            " ".join(b.text for b, p in zip(blocks, own, strict=True) if p > 0.5)
            for blocks, own in zip(group, chosen, strict=True)
        ]
        if len(self.paths.parents) > MOST_PATHS:
            self._forget()
        return texts

    def texts(self, pages: Iterator[str | None]) -> Iterator[str]:
        group: list[list[Block]] = []
        size = 0
        for page in pages:
            group.append(page_blocks(page or "", self.paths))
            size += len(group[-1]) + 1
            if size >= GROUP:
                yield from self._scored(group)
                group, size = [], 0
        yield from self._scored(group)


def extractor(network: Network):
    """An Arrow function html -> main text."""

    @F.arrow_udf(T.StringType())
    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Extractor(network)
        for batch in batches:
            yield pa.array(own.texts(v.as_py() for v in batch), pa.string())

    return extract


def extract_pages(pages: DataFrame, network: Network | None = None) -> DataFrame:
    """Per row of ``page_id, url, html``: ``page_id, url, text, n_chars``."""
    network = labeller() if network is None else network
    found = pages.select("page_id", "url", extractor(network)(F.col("html")).alias("text"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
