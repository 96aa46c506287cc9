"""The product master: matching by identity, merging by source, repair of ids that clash.

Tables have the columns of ``PRODUCT``; names and identifiers are compared in the
forms of ``prepared``. A batch sees the master as it was when the batch began, and
its own rows of one identity are one product.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import combinations
from operator import and_, or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyreef.functions import names
from tallyreef.functions.text import blank, first_filled
from tallyreef.operators.resolve import conflict
from tallyreef.operators.windows import ranked
from tallyreef.sources.scratch import written

ID_FIELDS = tuple(name for name, _ in names.IDENTIFIERS)
#: Aliases and addresses that a product keeps at most.
MOST_VALUES = 50


def prepared(df: DataFrame, category: Column, name: Column, kind: Column, brand: Column, ids: dict[str, Column]) -> DataFrame:
    """All columns and category, plain, strong, kind, brand and one column for each identifier, in the forms that are compared."""
    found = names.identifiers(ids)
    return df.select("*", category.alias("m_category"), names.product_name(name).alias("m_plain"), names.strong_product_name(name).alias("m_strong"), names.kind(kind).alias("m_kind"), names.brand(brand).alias("m_brand"), *[found[f].alias(f"m_{f}") for f in ID_FIELDS])


_FORMS = ("m_category", "m_plain", "m_strong", "m_kind", "m_brand", *(f"m_{f}" for f in ID_FIELDS))


def _any(form: str) -> Column:
    """What a known row's form is looked up by: itself, and the key of rows that lack it, which take any."""
    return F.explode(F.array(F.concat(F.lit("="), F.col(form)), F.lit("any")))


def _wanted(form: str) -> Column:
    """The keys under which an incoming row's form finds what does not clash with it, each known row once."""
    return F.explode(F.when(F.col(form) == "", F.array(F.lit("any"))).otherwise(F.array(F.lit("="), F.concat(F.lit("="), F.col(form)))))


def _subsets(fields: Sequence[str]) -> list[tuple[str, ...]]:
    return [some for n in range(1, len(fields) + 1) for some in combinations(fields, n)]


def _told(what: str, fields: Sequence[str]) -> Column:
    """A kind of look-up and the values that must agree; null if one is not there."""
    return F.struct(F.lit(what).alias("what"), F.concat(*[x for c in fields for x in (F.col(c), F.lit("|"))]).alias("value"))


def matches(known: DataFrame, incoming: DataFrame, known_id: str, incoming_id: str) -> DataFrame:
    """incoming_id, match and method for each incoming row; both tables are prepared.

    Rows of one category whose kinds and brands do not clash are compared: by
    identifier where the incoming row has one, else by name and then by strong name
    among known rows without identifiers. Only exactly one partner is a match.

    Nothing is paired: known rows are counted by what they may be asked for, and an
    incoming row looks up a few counts. A known row that has the identifiers K agrees with one that
    has I if all of K and I in common, at least one, are equal; so it is counted under K and the values
    of each part of K. Kinds and brands are counted by value and in all. Whether any known row
    has another identifier is told by the least and greatest of each kind and brand.
    """
    ids = [f"m_{f}" for f in ID_FIELDS]
    patterns = _subsets(ids)
    has = F.coalesce(*[F.col(c) for c in ids]).isNotNull()
    signed = known.groupBy(*_FORMS).agg(F.count("*").alias("n"), F.min(known_id).alias("first"))
    # Both sides are compared in several ways: their forms are worked out once.
    signed = written(signed, "match-known")
    asked = written(incoming.select(incoming_id, *_FORMS), "match-incoming")
    name = lambda there: [F.when(there & (F.col(form) != ""), _told(form, [form])) for form in ("m_plain", "m_strong")]
    label = lambda k, some: " ".join(k) + ":" + " ".join(some)
    exactly = lambda k: F.concat_ws(" ", *[F.when(F.col(c).isNotNull(), c) for c in ids]) == " ".join(k)
    offered = [F.when(exactly(k), _told(label(k, some), some)) for k in patterns for some in _subsets(k)]
    # Of K and I, some is what they have in common.
    common = lambda k, some: F.when(reduce(and_, [F.col(c).isNotNull() if c in some else F.col(c).isNull() for c in k]), _told(label(k, some), some))
    sought = [common(k, some) for k in patterns for some in _subsets(k)]
    keys = ["m_category", "what", "value", "kind_key", "brand_key"]
    spread = lambda df, entries: df.withColumn("__told", F.explode(F.array_compact(F.array(*entries)))).select("*", "__told.*")
    counted = spread(signed, offered + name(~has)).withColumn("kind_key", _any("m_kind")).withColumn("brand_key", _any("m_brand")).groupBy(*keys).agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    looked = spread(asked, sought + name(~has)).withColumn("kind_key", _wanted("m_kind")).withColumn("brand_key", _wanted("m_brand")).select(incoming_id, *keys)
    met = looked.join(counted, keys)
    kinds = {"name": F.col("what") == "m_plain", "strong": F.col("what") == "m_strong", "id": ~F.col("what").isin("m_plain", "m_strong")}
    found = met.groupBy(incoming_id).agg(*[x for n, is_ in kinds.items() for x in (F.sum(F.when(is_, F.col("n"))).alias(f"n_{n}"), F.min(F.when(is_, F.col("first"))).alias(f"by_{n}"))])
    # A known row of other identifiers: some kind and brand that fit have one that is less or greater.
    groups = signed.withColumn("kind_key", _any("m_kind")).withColumn("brand_key", _any("m_brand")).groupBy("m_category", "kind_key", "brand_key").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ids for f in (F.min, F.max)])
    other = reduce(or_, [conflict(F.col(f"{f}_{c}"), F.col(c)) for c in ids for f in ("min", "max")])
    near = asked.filter(has).withColumn("kind_key", _wanted("m_kind")).withColumn("brand_key", _wanted("m_brand"))
    clashing = near.join(groups, ["m_category", "kind_key", "brand_key"]).filter(other).select(incoming_id, F.lit(True).alias("clashes")).distinct()
    out = asked.select(incoming_id, has.alias("__has")).join(found, incoming_id, "left").join(clashing, incoming_id, "left")
    method = (
        F.when(F.col("__has"), F.when(F.col("n_id") == 1, "identifier").when(F.col("n_id") > 1, "ambiguous_identifier").when(F.col("clashes"), "identifier_conflict").otherwise("no_match"))
        .when(F.col("n_name") == 1, "normalized_name").when(F.col("n_name") > 1, "ambiguous_normalized_name")
        .when(F.col("n_strong") == 1, "strong_name").when(F.col("n_strong") > 1, "ambiguous_strong_name").otherwise("no_match")
    )
    out = out.withColumn("method", method)
    match = F.when(F.col("method") == "identifier", F.col("by_id")).when(F.col("method") == "normalized_name", F.col("by_name")).when(F.col("method") == "strong_name", F.col("by_strong"))
    return out.select(incoming_id, match.alias("match"), "method")


def reference_confidence(method: Column) -> Column:
    """How sure a matched product is."""
    return F.when(method == "identifier", 1.0).when(method.isin("normalized_name", "strong_name"), 0.8).otherwise(0.0)


def source_priority(explicit: Column, source_type: Column, source_name: Column, has_sites: Column) -> Column:
    """A stated priority, else that of makers before shops before others."""
    kind, name = F.lower(blank(source_type)), F.lower(blank(source_name))
    official = kind.isin("official", "official_source", "auto_monitor") | name.contains("メーカー公式") | name.endswith("公式")
    shop = kind.isin("retail_search", "official_store", "card_shop") | name.contains("ショップ") | name.contains("ストア") | F.coalesce(has_sites, F.lit(False))
    stated = explicit.try_cast("int")
    return F.coalesce(F.when(stated.isNotNull(), F.greatest(F.lit(0), stated)), F.when(official, 300).when(shop, 200).otherwise(100))


def safe_to_merge(names_: tuple[Column, Column], kinds: tuple[Column, Column], brands: tuple[Column, Column], categories: tuple[Column, Column], ids: Sequence[tuple[Column, Column]], urls: tuple[Column, Column]) -> Column:
    """Rows of one id are one product: nothing clashes, and a name, an identifier, or without names the address agrees."""
    filled = lambda pair: (pair[0] != "") & (pair[1] != "")
    clash = (filled(kinds) & (kinds[0] != kinds[1])) | (filled(brands) & (brands[0] != brands[1])) | (categories[0] != categories[1])
    same_id = F.lit(False)
    for a, b in ids:
        clash = clash | conflict(a, b)
        same_id = same_id | F.coalesce(a == b, F.lit(False))
    named = filled(names_)
    address = lambda c: F.regexp_replace(F.lower(blank(c)), "/+$", "")
    same_url = ~named & (address(urls[0]) != "") & (address(urls[0]) == address(urls[1]))
    return ~F.coalesce(clash, F.lit(False)) & ((named & (names_[0] == names_[1])) | same_id | same_url)


def split_conflicting_ids(df: DataFrame, id_col: str, order: str) -> DataFrame:
    """Rows of one id that clash with rows before them get an id of their own: the new id in place, old_id, and whether it was split.

    A row clashes if its category, kind, brand or an identifier differs, where both
    are filled, from that of a row of the id that kept it. Rows that kept an id agree, so
    each of these has one value an id, that of the first such row that fills it; and a row
    clashes if it clashes with these. They are found in rounds: of the rows that clash with
    no value so far, the first that fills one more keeps the id. A round settles at least
    one value of each id, so there are as many as values at most, and no id is ever listed.
    The new id is that of the row's content; further rows of the same content get the
    hash of it and their number. df is prepared; rows without an id stay.
    """
    forms = ["m_category", "m_kind", "m_brand", *(f"m_{f}" for f in ID_FIELDS)]
    keyed = df.select("*", *[F.coalesce(F.col(c), F.lit("")).alias(f"__{c}") for c in forms])
    parts = [f"__{c}" for c in forms]
    kinds = written(keyed.filter(blank(F.col(id_col)) != "").groupBy(id_col, *parts).agg(F.min(order).alias("at")), "id-kinds")
    clash, fills = F.lit(False), F.lit(False)
    for c in parts:
        clash = clash | ((F.col(c) != "") & (F.col(f"has{c}") != "") & (F.col(c) != F.col(f"has{c}")))
        fills = fills | ((F.col(c) != "") & (F.col(f"has{c}") == ""))
    state = kinds.select(id_col, *[F.lit("").alias(f"has{c}") for c in parts]).distinct()
    for _ in parts:
        state = written(state, "id-values")
        first = kinds.join(state, id_col).filter(~clash & fills).groupBy(id_col).agg(F.min_by(F.struct(*parts), "at").alias("__first"))
        first = written(first, "id-first")
        if first.isEmpty():
            break
        state = state.join(first, id_col, "left").select(id_col, *[F.when(F.col(f"has{c}") == "", F.coalesce(F.col(f"__first.{c}"), F.lit(""))).otherwise(F.col(f"has{c}")).alias(f"has{c}") for c in parts])
    told = kinds.join(state, id_col).filter(clash).select(id_col, *parts, F.lit(True).alias("split"))
    own = names.content_id(F.col("m_category"), F.col("m_strong"), F.col("m_kind"), F.col("m_brand"), {f: F.col(f"m_{f}") for f in ID_FIELDS})
    out = keyed.join(told, [id_col, *parts], "left").withColumn("split", F.coalesce("split", F.lit(False))).withColumn("__own", own).drop(*parts)
    rank = F.row_number().over(Window.partitionBy("__own").orderBy(order)) - 1
    moved = out.filter("split").withColumn("old_id", F.col(id_col).cast("string")).withColumn("__n", rank)
    moved = moved.withColumn(id_col, F.when(F.col("__n") == 0, F.col("__own")).otherwise(F.substring(F.sha2(F.concat_ws("|", "__own", F.col("__n").cast("string")), 256), 1, 16))).drop("__n")
    stayed = out.filter("not split").withColumn("old_id", F.col(id_col).cast("string")).withColumn(id_col, F.col(id_col).cast("string"))
    return stayed.unionByName(moved).drop("__own")


def attributes(df: DataFrame, key: str, order: str, fields: Sequence[str], priority: str, manual: str | None = None) -> DataFrame:
    """One row a key: of each field the value of the best source, the latest among equals; blanks overwrite nothing, and a manual row's values stay."""
    by = F.struct(*([F.coalesce(F.col(manual), F.lit(False))] if manual else []), F.col(priority), F.col(order))
    return df.groupBy(key).agg(*[F.max_by(f, F.when(blank(F.col(f)) != "", by)).alias(f) for f in fields])


def gathered(df: DataFrame, key: str, order: str, value: Column, name: str, most: int = MOST_VALUES) -> DataFrame:
    """key and the distinct values of each in the order of their first row, the first ``most``; rows of one place stand by their values."""
    each = df.select(key, F.col(order).alias("__at"), value.alias("__v")).filter(F.col("__v").isNotNull())
    once = each.groupBy(key, "__v").agg(F.min("__at").alias("__at"))
    return ranked(once, [key], [F.col("__at"), F.col("__v")], most).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", "__v"))), lambda x: x["__v"]).alias(name))


def merged_sites(df: DataFrame, key: str, order: str, site: Sequence[str], alias: Column) -> DataFrame:
    """key, n, the distinct sites of all rows in the order in which they came, and the aliases, sorted where a key has several rows, as they stand where it has one."""
    rows = df.withColumn("__alias", alias)
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    sites = gathered(rows, key, order, F.struct(*site), "sites", 1 << 30)
    names_ = gathered(rows, key, order, F.col("__alias"), "aliases", 1 << 30)
    out = counts.join(sites, key, "left").join(names_, key, "left")
    return out.withColumn("aliases", F.when(F.col("n") > 1, F.array_sort("aliases")).otherwise(F.col("aliases")))


def folded_dates(df: DataFrame, key: str, order: Sequence[str], date: str = "date", priority: str = "priority", seen: str = "seen") -> DataFrame:
    """key, date, priority, changes and rejected (the last reason of a date not taken) after all sightings of a key in order.

    A sighting is taken by its source's priority, its time and the dates that were
    given up before, so each key is folded; its sightings stream through one task
    in order, which holds the given-up dates of one key at a time.
    """
    columns = [key, date, priority, seen]

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for frame in frames:
            done = []
            for k, d, p, s in frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False):
                if state is None or k != current:
                    if state is not None:
                        done.append((current, state["date"], state["priority"], state["changes"], state["rejected"]))
                    current, state = k, {"date": None, "priority": None, "seen": None, "past": set(), "changes": 0, "rejected": None}
                reason = _sighting(state, d, p, s)
                if reason in ("existing_date_unknown", "trusted_newer_observation"):
                    if state["date"] is not None:
                        state["past"].add(state["date"])
                    state |= {"date": d, "priority": p, "seen": s if s is not None else state["seen"], "changes": state["changes"] + 1}
                elif d is not None and d != state["date"]:
                    state["rejected"] = reason
            if done:
                yield pd.DataFrame(done, columns=[key, "date", "priority", "changes", "rejected"])
        if state is not None:
            yield pd.DataFrame([(current, state["date"], state["priority"], state["changes"], state["rejected"])], columns=[key, "date", "priority", "changes", "rejected"])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    kept = df.select(*dict.fromkeys([*columns, *order]))
    return kept.repartition(key).sortWithinPartitions(key, *order).mapInPandas(fold, f"`{key}` {kinds[key]}, date {kinds[date]}, priority {kinds[priority]}, changes long, rejected string")


def _sighting(state: dict, date, priority, seen) -> str:
    """The rules of date_decision for one sighting."""
    if date is None:
        return "incoming_date_unknown"
    if state["date"] is None:
        return "existing_date_unknown"
    if date == state["date"]:
        return "same_date"
    if priority < state["priority"]:
        return "lower_priority_source"
    if seen is not None and state["seen"] is not None and seen < state["seen"]:
        return "older_observation"
    return "historical_date_rollback" if priority <= state["priority"] and date in state["past"] else "trusted_newer_observation"


def outcomes(merged: DataFrame, method: str, changed: Column) -> DataFrame:
    """Counts of added, updated, unchanged and ambiguous rows of a batch."""
    outcome = F.when(F.col(method).startswith("ambiguous") | (F.col(method) == "identifier_conflict"), "ambiguous").when(F.col(method) == "no_match", "added").when(changed, "updated").otherwise("unchanged")
    return merged.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def repair_report(split: DataFrame, id_col: str, safe: DataFrame) -> DataFrame:
    """What a repair would do: ids that split, and rows of one id that merge or may not; ``safe`` has id and safe for each later row of an id."""
    counts = split.agg(F.count_if("split").alias("split_rows"), F.countDistinct(F.when(F.col("split"), F.col("old_id"))).alias("split_ids"))
    merged = safe.agg(F.count_if("safe").alias("merged_rows"), F.count_if(~F.col("safe")).alias("unsafe_rows"))
    both = counts.unionByName(merged, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def shown_name(*columns: Column) -> Column:
    return names.display_name(first_filled(*columns))
