"""Shared plumbing: the shared folder, written tables and table access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scrutix.sources.tables import discard, materialize, shared_dir

__all__ = ["arrow_rows", "discard", "materialize", "shared_dir", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_rows(fn, schema, columns, flush_bytes: int = 8 << 20):
    """A ``mapInArrow`` function from a generator over rows.

    ``fn(*values)`` gets the values of ``columns`` of one row and yields
    ``(size_in_bytes, tuple)`` results, which are sent on in batches of about
    ``flush_bytes`` so memory stays bounded however long the rows are.
    """
    import pyarrow as pa

    def run(batches):
        rows, held = [], 0

        def batch():
            cols = zip(*rows) if rows else [[] for _ in schema]
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, schema)], schema=schema)

        for b in batches:
            cols = [b.column(b.schema.get_field_index(c)) for c in columns]
            for i in range(b.num_rows):
                for n, row in fn(*(c[i].as_py() for c in cols)):
                    rows.append(row)
                    held += n
                    if held >= flush_bytes or len(rows) >= 10_000:
                        yield batch()
                        rows, held = [], 0
        if rows:
            yield batch()

    return run
