"""The ordered set of loaded tables and what their schemas say about each other."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthcheck.plans import patterns as P
from hearthcheck.plans import roles as R


class TableSet(Mapping[str, DataFrame]):
    """Tables by name, in load order: where several could answer, the first one does.

    ``prefixes`` are the technical prefixes of this site's table names; add your own to the
    defaults. ``documented_keys`` are the only columns ever used as join keys by default.
    """

    def __init__(
        self,
        tables: Mapping[str, DataFrame] | None = None,
        prefixes: Sequence[str] = P.TABLE_PREFIXES,
        documented_keys: Iterable[str] = P.DOCUMENTED_KEYS,
        keep_columns: Iterable[str] = (),
    ):
        self.prefixes = tuple(prefixes)
        self.documented_keys = frozenset(k.lower() for k in documented_keys)
        self._keep = tuple(keep_columns)
        self._tables: dict[str, DataFrame] = {}
        for name, df in (tables or {}).items():
            self.add(name, df)

    def __getitem__(self, name: str) -> DataFrame:
        return self._tables[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._tables)

    def __len__(self) -> int:
        return len(self._tables)

    def add(self, name: str, df: DataFrame) -> DataFrame:
        """Load a table; person-name columns are dropped on the way in."""
        self._tables[name] = R.drop_person_names(df, self._keep)
        return self._tables[name]

    def publish(self, name: str, df: DataFrame) -> DataFrame:
        """Keep a derived table under a name and make it visible to SQL."""
        self._tables[name] = df
        df.createOrReplaceTempView(name)
        return df

    def only(self, *names: str) -> TableSet:
        """The same settings over fewer tables, order kept."""
        picked = TableSet(prefixes=self.prefixes, documented_keys=self.documented_keys)
        picked._tables = {n: df for n, df in self._tables.items() if n in names}
        return picked

    def with_role(self, keywords: Sequence[str], unless: Sequence[str] = ()) -> str | None:
        return R.table_for_role(self, keywords, unless, self.prefixes)

    def plays(self, name: str, keywords: Sequence[str]) -> bool:
        return R.plays_role(name, keywords, self.prefixes)

    def persons(self, exclude: str | None = None) -> str | None:
        return R.person_table(self, exclude, self.prefixes)

    def register_views(self) -> None:
        for name, df in self._tables.items():
            df.createOrReplaceTempView(name)

    # ------------------------------------------------------------- schema relations

    def all_columns(self) -> list[str]:
        """Every column name once, whatever its case, in the spelling met first."""
        seen: dict[str, str] = {}
        for df in self._tables.values():
            for c in df.columns:
                seen.setdefault(c.lower(), c)
        return list(seen.values())

    def tables_with_columns(self, columns: Iterable[str]) -> list[str]:
        wanted = {c.lower() for c in columns}
        if not wanted:
            return []
        return [n for n, df in self._tables.items() if wanted <= {c.lower() for c in df.columns}]

    def shared_columns(self, a: str, b: str) -> list[str]:
        """Columns of ``a`` that ``b`` has too, whatever the case, in the order of ``a``."""
        other = {c.lower() for c in self[b].columns}
        return [c for c in self[a].columns if c.lower() in other]

    def is_documented(self, column: str) -> bool:
        return column.strip().lower() in self.documented_keys

    def join_key(self, a: str, b: str) -> str | None:
        """First shared column that is a documented identifier; never a guess."""
        if a not in self or b not in self:
            return None
        return next((c for c in self.shared_columns(a, b) if self.is_documented(c)), None)

    def pairs(self) -> list[tuple[str, str]]:
        names = list(self)
        return [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]

    def relations(self) -> list[tuple[str, str, str, bool, bool]]:
        """(table_a, table_b, column, documented, recommended) for every shared column of every pair."""
        found = []
        for a, b in self.pairs():
            best = self.join_key(a, b)
            found += [(a, b, c, self.is_documented(c), c == best) for c in self.shared_columns(a, b)]
        return found

    def resolve_pair(self, mentioned: Sequence[str]) -> tuple[str, str] | None:
        """The two tables meant: the first two named, or the one named and the only one left."""
        pair = list(dict.fromkeys(mentioned))
        left = [n for n in self if n not in pair]
        if len(pair) == len(left) == 1:
            pair += left
        return (pair[0], pair[1]) if len(pair) > 1 else None

    def describe_schema(self) -> list[str]:
        """One line per table, then confirmed links, then shared columns that are not confirmed keys."""
        lines = [f"{n}({', '.join(df.columns)})" for n, df in self._tables.items()]
        for confirmed in (True, False):
            for a, b in self.pairs():
                shared = [
                    c
                    for c in self.shared_columns(a, b)
                    if c.strip().lower() != "id" and self.is_documented(c) is confirmed
                ]
                if shared:
                    kind = "confirmed" if confirmed else "unconfirmed"
                    lines.append(f"{kind}: {a} <-> {b} on {', '.join(shared)}")
        return lines

    # ------------------------------------------------------------- reports

    def summary(self, shown: int = 8) -> DataFrame:
        """Rows, columns and the first column names of each table, one counting scan per table."""
        parts = [
            df.agg(F.count(F.lit(1)).alias("n_rows")).select(
                F.lit(position).alias("position"),
                F.lit(name).alias("table"),
                "n_rows",
                F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
                F.lit(", ".join(df.columns[:shown]) + (", ..." if len(df.columns) > shown else "")).alias("columns"),
            )
            for position, (name, df) in enumerate(self._tables.items(), start=1)
        ]
        if not parts:
            raise ValueError("No table is loaded.")
        return reduce(DataFrame.unionByName, parts)

    def relation_report(self, a: str | None = None, b: str | None = None) -> DataFrame:
        """Shared columns of one pair or of all pairs, with the size of both tables.

        ``recommended`` marks the documented key to join on; ``warning`` is set where no shared
        column is documented.
        """
        for name in (a, b):
            if name is not None and name not in self:
                raise KeyError(f"Table not loaded: {name}")
        wanted = [r for r in self.relations() if a is None or {r[0], r[1]} == {a, b}]
        sized = {r[0] for r in wanted} | {r[1] for r in wanted}
        if not wanted:
            raise ValueError("No shared column between the loaded tables.")
        sizes = self.only(*sized).summary().select("table", "n_rows")
        listed = F.array(
            *[
                F.struct(
                    F.lit(x).alias("table_a"),
                    F.lit(y).alias("table_b"),
                    F.lit(c).alias("column"),
                    F.lit(ok).alias("documented"),
                    F.lit(best).alias("recommended"),
                    F.lit(self.join_key(x, y) is None).alias("warning"),
                )
                for x, y, c, ok, best in wanted
            ]
        )
        # One row per table carries its size to the pairs it takes part in.
        links = sizes.select("table", "n_rows", F.explode(listed).alias("r")).where(
            (F.col("table") == F.col("r.table_a")) | (F.col("table") == F.col("r.table_b"))
        )
        return links.groupBy("r").agg(
            F.max(F.when(F.col("table") == F.col("r.table_a"), F.col("n_rows"))).alias("rows_a"),
            F.max(F.when(F.col("table") == F.col("r.table_b"), F.col("n_rows"))).alias("rows_b"),
        ).select("r.*", "rows_a", "rows_b")


def load_parquet_tables(spark: SparkSession, folder: str, names: Iterable[str], **settings) -> TableSet:
    """A table set over parquet files called after their tables."""
    return TableSet({n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}, **settings)
