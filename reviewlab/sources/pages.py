"""Fields of review blocks in raw web pages."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlab.functions.text import strip
from reviewlab.operators.filters import fill_missing, require_reply
from reviewlab.sources.markup import Element, read_blocks

#: Blocks that a task hands on together.
ROWS = 4096


def extract_blocks(pages: DataFrame, block: Element, fields: Mapping[str, Element], page_fields: Mapping[str, Element] = {},
                   html: str = "html", row_id: str = "page_id") -> DataFrame:
    """One row per block: id, 0-based position, page fields, block fields.

    A field is what its element gives where it stands first, in the page or in the block: its text, if it holds nothing
    else, or an attribute; NULL if there is none. Pages are scanned once each, where they are; a missing page has no blocks.
    """
    kind = pages.schema[row_id].dataType.simpleString()
    names = [*page_fields, *fields]
    schema = ", ".join([f"`{row_id}` {kind}", "at int", *[f"`{n}` string" for n in names]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            rows, of, at = [], [], []

            def made() -> pa.RecordBatch:
                cells = [pa.array([r[i] for r in rows], pa.string()) for i in range(len(names))]  # noqa: B023
                return pa.record_batch([ids.take(pa.array(of, pa.int32())), pa.array(at, pa.int32()), *cells], [row_id, "at", *names])  # noqa: B023

            for i, page in enumerate(batch.column(1).to_pylist()):
                for k, row in enumerate(read_blocks(page or "", block, fields, page_fields)):
                    rows.append(row)
                    of.append(i)
                    at.append(k)
                    if len(rows) >= ROWS:
                        yield made()
                        rows, of, at = [], [], []
            if rows:
                yield made()

    return pages.select(row_id, html).mapInArrow(work, schema)


# Elements of a review page and of a listing page.
REVIEW_BLOCK = Element("li", {"class_": "list-group-item star-point ng-scope", "ng_repeat": "review in restaurant.reviews"})
STORE_NAME = Element("span", {"class_": "restaurant-name ng-binding"})
REVIEW_FIELDS = {
    "taste": Element("span", {"class_": "points ng-binding", "ng_show": "review.rating_taste > 0"}),
    "quantity": Element("span", {"class_": "points ng-binding", "ng_show": "review.rating_quantity > 0"}),
    "delivery": Element("span", {"class_": "points ng-binding", "ng_show": "review.rating_delivery > 0"}),
    "menu": Element("div", {"class_": "order-items default ng-binding"}),
    "customer_id": Element("span", {"class_": "review-id ng-binding", "ng_show": "review.phone"}),
    "review": Element("p", {"class_": "ng-binding", "ng_show": "review.comment"}),
    "reply": Element("p", {"class_": "ng-binding", "ng_bind_html": "review.owner_reply.comment|strip_html"}),
}
STORE_ENTRY = Element("div", {"class_": "restaurant-name ng-binding"})


def extract_stores(pages: DataFrame, html: str = "html", row_id: str = "page_id") -> DataFrame:
    """Store names of listing pages, in page order."""
    return extract_blocks(pages, STORE_ENTRY, {"store": STORE_ENTRY}, html=html, row_id=row_id)


def extract_reviews(pages: DataFrame, html: str = "html", row_id: str = "page_id") -> DataFrame:
    """Answered reviews of review pages, with placeholders for missing ratings and menus."""
    rows = extract_blocks(pages, REVIEW_BLOCK, REVIEW_FIELDS, {"store": STORE_NAME}, html, row_id)
    return fill_missing(require_reply(rows.withColumn("reply", strip(F.col("reply")))))
