"""Data-quality audits for the declared rules Parquet does not enforce (DQ1-DQ7).

Each audit returns a violations DataFrame (empty when the rule holds).
Delete rules (DQ6) are applied as set operations over the whole key set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockflow.functions.scalars import collated
from stockflow.schemas import (CHECKS, COLLATED_KEYS, DOMAINS, FOREIGN_KEYS, MAX_LENGTHS, NOT_NULL,
                               UNIQUE_KEYS)


def unique_violations(df: DataFrame, keys: list[str], collate: tuple[str, ...] = ()) -> DataFrame:
    """DQ1: key values held by more than one row (rows with a null key part
    are exempt, as in SQL unique keys). Collated columns compare
    case/accent-insensitively; the output shows their smallest lower-cased
    spelling."""
    by = [(collated(F.col(c)) if c in collate else F.col(c)).alias(f"_k{i}") for i, c in enumerate(keys)]
    shown = [(F.min(F.lower(F.col(c))) if c in collate else F.min(c)).alias(c) for c in keys]
    nn = F.lit(True)
    for c in keys:
        nn = nn & F.col(c).isNotNull()
    return (df.where(nn).groupBy(*by).agg(*shown, F.count("*").alias("n_rows"))
            .where(F.col("n_rows") > 1).select(*keys, "n_rows"))


def fk_violations(child: DataFrame, parent: DataFrame, child_cols: list[str],
                  parent_cols: list[str] | None = None) -> DataFrame:
    """DQ2: child rows whose non-null foreign key has no parent row."""
    pc = parent_cols or child_cols
    p = parent.select(*[F.col(a).alias(b) for a, b in zip(pc, child_cols)]).distinct()
    nn = F.lit(True)
    for c in child_cols:
        nn = nn & F.col(c).isNotNull()
    return child.where(nn).join(p, child_cols, "left_anti")


def _failures(df: DataFrame, failed: dict[str, Column], label: str) -> DataFrame:
    """One row per (row, failed rule) from a single scan."""
    names = F.array(*[F.when(c, F.lit(n)) for n, c in failed.items()]) if failed else F.array().cast("array<string>")
    return df.withColumn(label, F.explode(F.array_compact(names)))


def null_violations(df: DataFrame, cols: list[str]) -> DataFrame:
    """DQ3: rows with a null in a NOT NULL column; one row per (row, column)."""
    return _failures(df, {c: F.col(c).isNull() for c in cols}, "column")


def check_violations(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """DQ4: rows failing a CHECK rule (SQL text that must hold; null passes,
    as in SQL). One row per (row, rule)."""
    return _failures(df, {n: ~F.coalesce(F.expr(e), F.lit(True)) for n, e in rules.items()}, "rule")


def domain_violations(df: DataFrame, col: str, values: tuple[str, ...]) -> DataFrame:
    """DQ5: rows whose value is outside the declared domain (null passes)."""
    return df.where(F.col(col).isNotNull() & ~F.col(col).isin(*values))


def length_violations(df: DataFrame, limits: dict[str, int]) -> DataFrame:
    """DQ7: rows with a string longer than its declared length."""
    own = {c: n for c, n in limits.items() if c in df.columns}
    out = _failures(df, {c: F.length(F.col(c)) > n for c, n in own.items()}, "column")
    limit = F.lit(None).cast("int")
    for c, n in own.items():
        limit = F.when(F.col("column") == c, F.lit(n)).otherwise(limit)
    return out.withColumn("max_length", limit)


def _counted(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def row_audit(tables: dict[str, DataFrame]) -> DataFrame:
    """DQ3, DQ4, DQ5, DQ7: every declared NOT NULL, CHECK, domain and length
    rule of every table, one scan per table: (tbl, kind, rule, n_rows) of the
    rules that some row breaks."""
    parts = []
    for name, df in tables.items():
        failed = {f"not null:{c}": F.col(c).isNull() for c in NOT_NULL.get(name, ()) if c in df.columns}
        failed |= {f"check:{n}": ~F.coalesce(F.expr(e), F.lit(True)) for n, e in CHECKS.get(name, {}).items()}
        failed |= {f"domain:{c}": F.col(c).isNotNull() & ~F.col(c).isin(*values)
                   for (t, c), values in DOMAINS.items() if t == name}
        failed |= {f"length:{c}": F.length(F.col(c)) > n for c, n in MAX_LENGTHS.get(name, {}).items() if c in df.columns}
        parts.append(_failures(df, failed, "_rule").groupBy("_rule").agg(F.count("*").alias("n_rows")).select(
            F.lit(name).alias("tbl"), F.split_part("_rule", F.lit(":"), F.lit(1)).alias("kind"),
            F.split_part("_rule", F.lit(":"), F.lit(2)).alias("rule"), "n_rows"))
    return _counted(parts)


def unique_audit(tables: dict[str, DataFrame]) -> DataFrame:
    """DQ1: every declared unique key of every table: (tbl, rule, n_rows), the
    number of key values that more than one row holds."""
    parts = []
    for name, df in tables.items():
        for keys in UNIQUE_KEYS.get(name, []):
            collate = tuple(c for c in keys if (name, c) in COLLATED_KEYS)
            parts.append(unique_violations(df, list(keys), collate).agg(F.count("*").alias("n_rows")).select(
                F.lit(name).alias("tbl"), F.lit(",".join(keys)).alias("rule"), "n_rows"))
    return _counted(parts).where(F.col("n_rows") > 0)


def fk_audit(tables: dict[str, DataFrame]) -> DataFrame:
    """DQ2: orphans of every declared foreign key: (child, fk, fk_value, n_rows).

    Every table is scanned once: a row gives each of its non-null references,
    by link, and its own key, as a parent, to each link that points at it. One
    aggregation over (link, value) then counts the references and sees whether
    the parent is there; a value that very many rows refer to is summed before
    the shuffle. Most values are met a few times only, so nearly every row makes
    a group: a group is kept to one number and one flag, whatever the number
    of links.
    """
    links = [(child, cols[0], parent, pcols[0]) for child, cols, parent, pcols, _ in FOREIGN_KEYS
             if child in tables and parent in tables and cols[0] in tables[child].columns]
    parts = []
    for name, df in tables.items():
        roles = [F.struct(F.lit(k).alias("link"), F.col(pk if own else fk).cast("long").alias("value"), F.lit(own).alias("own"))
                 for k, (child, fk, parent, pk) in enumerate(links) for own in (True, False) if name == (parent if own else child)]
        if roles:
            parts.append(df.select(F.inline(F.array(*roles))).where(F.col("value").isNotNull()))
    counts = (_counted(parts).groupBy("link", "value")
              .agg(F.bool_or("own").alias("_there"), F.count_if(~F.col("own")).alias("n_rows")))

    def named(i: int) -> Column:
        return F.element_at(F.array(*[F.lit(x[i]) for x in links]), F.col("link") + 1)

    return counts.where(~F.col("_there")).select(named(0).alias("child"), named(1).alias("fk"), F.col("value").alias("fk_value"), "n_rows")


def delete_with_rules(parent: DataFrame, parent_key: str, keys: DataFrame,
                      cascade: dict[str, tuple[DataFrame, str]] | None = None,
                      set_null: dict[str, tuple[DataFrame, str]] | None = None,
                      restrict: dict[str, tuple[DataFrame, str]] | None = None) -> dict[str, DataFrame]:
    """DQ6: delete parent rows honouring the child tables' delete rules.

    A key referenced by any RESTRICT child is refused (``rejected`` with the
    blocking table and count). Deletable keys are removed from the parent;
    CASCADE children lose their rows; SET NULL children get a null FK.
    """
    k = keys.select(F.col(keys.columns[0]).alias(parent_key)).distinct()
    k = k.join(parent.select(parent_key), parent_key, "left_semi")
    blocks = None
    for name, (child, fk) in (restrict or {}).items():
        b = (child.groupBy(F.col(fk).alias(parent_key)).agg(F.count("*").alias("n_refs"))
             .join(k, parent_key, "left_semi").withColumn("blocked_by", F.lit(name)))
        blocks = b if blocks is None else blocks.unionByName(b)
    if blocks is None:
        ok = k
        rejected = k.where(F.lit(False)).withColumn("blocked_by", F.lit(None).cast("string")) \
                    .withColumn("n_refs", F.lit(0).cast("long"))
    else:
        rejected = blocks
        ok = k.join(blocks.select(parent_key), parent_key, "left_anti")
    out = {"parent": parent.join(ok, parent_key, "left_anti"), "deleted": ok, "rejected": rejected}
    for name, (child, fk) in (cascade or {}).items():
        out[name] = child.join(ok.select(F.col(parent_key).alias(fk)), fk, "left_anti")
    for name, (child, fk) in (set_null or {}).items():
        hit = ok.select(F.col(parent_key).alias(fk)).withColumn("_hit", F.lit(True))
        cols = [F.when(F.col("_hit"), F.lit(None).cast(child.schema[fk].dataType)).otherwise(F.col(fk)).alias(fk)
                if c == fk else F.col(c) for c in child.columns]
        out[name] = child.join(hit, fk, "left").select(*cols)
    return out


def delete_by_declared_rules(tables: dict[str, DataFrame], table: str, keys: DataFrame) -> dict[str, DataFrame]:
    """DQ6: delete rows of ``table`` by primary key under all declared foreign
    keys, over as many levels as they reach.

    A key is refused if a RESTRICT child refers to it, or to a row that its
    deletion would take along; nothing of a refused key is deleted. CASCADE
    children go (and theirs), SET NULL children lose the reference. Returns the
    tables afterwards, ``deleted`` and ``refused`` (key, blocked_by). Each
    level is one join per child; the declared links have no CASCADE cycle.
    """
    pk = UNIQUE_KEYS[table][0][0]
    asked = keys.select(F.col(keys.columns[0]).alias("_root")).distinct()
    asked = asked.join(tables[table].select(F.col(pk).alias("_root")), "_root", "left_semi")

    def reach(parent: str, hit: DataFrame) -> list[tuple[str, str, str, DataFrame]]:
        """(rule, child, column, rows of the child as (_root, key)) of everything below ``hit(_root, _key)``."""
        out = []
        for child, cols, target, _, rule in FOREIGN_KEYS:
            if target != parent or child not in tables or cols[0] not in tables[child].columns:
                continue
            own = UNIQUE_KEYS[child][0][0] if child in UNIQUE_KEYS else "log_id"
            rows = (tables[child].select(F.col(own).alias("_child"), F.col(cols[0]).alias("_key")).join(hit, "_key")
                    .select("_root", F.col("_child").alias("_key")))
            out.append((rule, child, own if rule == "CASCADE" else cols[0], rows))
            if rule == "CASCADE":
                out += reach(child, rows)
        return out

    below = reach(table, asked.withColumn("_key", F.col("_root")))
    blocks = [rows.groupBy("_root").agg(F.count("*").alias("n_refs")).withColumn("blocked_by", F.lit(child))
              for rule, child, _, rows in below if rule == "RESTRICT"]
    refused = _counted(blocks) if blocks else asked.where(F.lit(False)).select(
        "_root", F.lit(0).cast("long").alias("n_refs"), F.lit("").alias("blocked_by"))
    free = asked.join(refused, "_root", "left_anti")
    out = dict(tables)
    out[table] = tables[table].join(free.select(F.col("_root").alias(pk)), pk, "left_anti")
    for rule, child, col, rows in below:
        gone = rows.join(free, "_root", "left_semi").select("_key").distinct()
        if rule == "CASCADE":
            out[child] = out[child].join(gone.select(F.col("_key").alias(col)), col, "left_anti")
        elif rule == "SET NULL":
            own = UNIQUE_KEYS[child][0][0] if child in UNIQUE_KEYS else "log_id"
            hit = gone.select(F.col("_key").alias(own)).withColumn("_hit", F.lit(True))
            kept = [F.when(F.col("_hit"), F.lit(None).cast(out[child].schema[c].dataType)).otherwise(F.col(c)).alias(c)
                    if c == col else F.col(c) for c in tables[child].columns]
            out[child] = out[child].join(hit, own, "left").select(*kept)
    return {**out, "deleted": free.select(F.col("_root").alias(pk)),
            "refused": refused.select(F.col("_root").alias(pk), "blocked_by", "n_refs")}
