"""A thin, immutable, lazy builder over Spark DataFrames with checks while the plan is built."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tessera.errors import EngineError
from tessera.functions.aggregates import Aggregate
from tessera.functions.expressions import Col, Expression, field_type
from tessera.functions.predicates import Predicate
from tessera.plans import rewrites


class Frame:
    """Every verb gives a new frame; ``df`` is the Spark plan so far. Nothing runs before ``collect``."""

    def __init__(self, df: DataFrame):
        self.df = df

    @classmethod
    def scan(cls, spark: SparkSession, path: str, columns: Sequence[str] = ("*",)) -> Frame:
        """A Parquet table; Spark reads only the columns that the plan needs."""
        frame = cls(spark.read.parquet(path))
        return frame if list(columns) == ["*"] or not columns else frame.select(*columns)

    def _known(self, *names: str) -> None:
        for name in names:
            field_type(self.df.schema, name)

    def select(self, *columns: str) -> Frame:
        self._known(*columns)
        return Frame(self.df.select(*columns))

    def filter(self, predicate: Predicate) -> Frame:
        """Rows for which the predicate holds; after ``aggregate`` this is HAVING."""
        return Frame(self.df.filter(predicate.resolve(self.df.schema)))

    def project(self, *expressions: Expression) -> Frame:
        """All columns and these, which see the input only, not each other; equal names are replaced."""
        return Frame(self.df.withColumns({e.name: e.resolve(self.df.schema) for e in expressions}))

    def drop(self, *columns: str) -> Frame:
        self._known(*columns)
        return Frame(self.df.drop(*columns))

    def reorder(self, *columns: str) -> Frame:
        """Exactly these columns in this order; one may come twice."""
        self._known(*columns)
        return Frame(self.df.select(*columns))

    def aggregate(self, keys: Sequence[str | Expression], aggregates: Sequence[Aggregate], rewrite: bool = True) -> Frame:
        """One row per group, or one row in all without keys. ``rewrite=False`` leaves out the
        rewrites, which never change a result."""
        schema = self.df.schema
        keys = [Col(k) if isinstance(k, str) else k for k in keys]
        names = [x.name for x in (*keys, *aggregates)]
        if len(set(names)) < len(names):
            raise EngineError(f"output names repeat: {names}")
        group, follow = rewrites.split_keys(keys) if rewrite else (keys, [])
        base, made = rewrites.shared_sums(aggregates, schema) if rewrite else ([], {})
        direct = [a.resolve(schema).alias(a.name) for a in aggregates if a.name not in made]
        if not (direct or base):
            raise EngineError("nothing to aggregate")
        out = self.df.groupBy(*[k.resolve(schema).alias(k.name) for k in group]).agg(*direct, *base)
        late = {k.name: k.resolve(schema) for k in follow}
        if not (late or made):
            return Frame(out)
        texts = {name: f"{made.get(name, rewrites.quoted(name))} AS {rewrites.quoted(name)}" for name in names}
        if not late:
            return Frame(out.selectExpr(*texts.values()))
        return Frame(out.select(*[late[name].alias(name) if name in late else F.expr(texts[name]) for name in names]))

    def order_by(self, *keys: str | tuple[str, bool], limit: int | None = None, offset: int = 0) -> Frame:
        """Sort by ``column`` or ``(column, descending)``. With a limit Spark keeps the best rows per
        task and never sorts the whole table."""
        pairs = [(k, False) if isinstance(k, str) else k for k in keys]
        self._known(*[name for name, _ in pairs])
        if (limit is not None and limit < 0) or offset < 0:
            raise EngineError("limit and offset must not be negative")
        out = self.df.orderBy(*[F.desc(name) if down else F.asc(name) for name, down in pairs])
        if offset:
            out = out.offset(offset)
        return Frame(out if limit is None else out.limit(limit))

    def limit(self, rows: int) -> Frame:
        """Any ``rows`` rows; stops reading early."""
        if rows < 0:
            raise EngineError("limit must not be negative")
        return Frame(self.df.limit(rows))

    def collect(self) -> list[Row]:
        return self.df.collect()

    def result(self, name: str) -> list:
        """All values of one result column."""
        self._known(name)
        return [row[0] for row in self.df.select(name).collect()]
