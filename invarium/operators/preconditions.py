"""Preconditions: when does a hypothesis hold.

Examples are records of named groups; ``fields`` is their unpivot
(hyp_id, example_id, positive, record_pos, field, value_json), a missing value
having no row.  Clauses are mined from positives by aggregation, tested on all
examples by aggregation, and combined into a disjunction of conjunctions.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from invarium.schema import kind_of

#: What a field's name must start with to be used, and fields that never are.
FIELD_PREFIXES = ("process_id", "thread_id", "meta_vars", "var_name", "function", "exception", "attributes", "var_type", "context_managers")
UNUSED_FIELDS = ("func_call_id", "process_id", "thread_id", "time", "type", "mode", "stack_trace", "obj_id")
#: Distinct values up to which a constant stays one: strings, others.
MOST_STRINGS, MOST_OTHERS = 4, 1
MOST_EXAMPLES, MOST_DEPTH = 5000, 8
CONTEXT = "context_managers."
#: Lists into which the conjunctions of one set of clauses are dealt.
ID_LISTS = 64


def capped(examples: DataFrame, most: int = MOST_EXAMPLES) -> DataFrame:
    """At most ``most`` positives and negatives of each hypothesis, chosen by hash."""
    w = Window.partitionBy("hyp_id", "positive").orderBy(F.xxhash64("example_id", F.lit(42)), "example_id")
    return examples.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= most).drop("__n")


def usable(fields: DataFrame, skip: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Fields by prefix, without the relation's own, that every record of their example has.

    ``skip``: fields that hypotheses of a relation (the part of ``hyp_id`` before
    its first ``|``) must not use.
    """
    wanted = F.lit(False)
    for p in FIELD_PREFIXES:
        wanted = wanted | F.col("field").startswith(p)
    rows = fields.filter(wanted & F.col("value_json").isNotNull() & ~F.col("field").isin(*UNUSED_FIELDS))
    for relation, names in (skip or {}).items():
        rows = rows.filter((F.substring_index("hyp_id", "|", 1) != relation) | ~F.col("field").isin(*names))
    size = fields.groupBy("hyp_id", "example_id").agg(F.count_distinct("record_pos").alias("n_records"))
    full = rows.groupBy("hyp_id", "example_id", "field").agg(F.count_distinct("record_pos").alias("n_with"))
    keep = full.join(size, ["hyp_id", "example_id"]).filter("n_with = n_records").select("hyp_id", "example_id", "field", "n_records")
    return rows.join(keep, ["hyp_id", "example_id", "field"])


def local_clauses(used: DataFrame) -> DataFrame:
    """Clause of each field in each example: one value ``constant``, all different ``unequal``, a context ``exist``."""
    seen = used.groupBy("hyp_id", "example_id", "positive", "field").agg(
        F.count_distinct("value_json").alias("n_values"), F.max("n_records").alias("n_records"), F.min("value_json").alias("value_json"), F.max(kind_of(F.col("value_json"))).alias("value_kind")
    )
    parts = F.size(F.split("field", r"\."))
    kind = (
        F.when(F.col("field").startswith(CONTEXT) & (parts == 2), "exist").when(F.col("n_values") == 1, "constant").when(F.col("n_values") == F.col("n_records"), "unequal")
    )
    value = F.when((F.col("n_values") == 1) & (kind == "constant"), F.col("value_json"))
    return seen.select("hyp_id", "example_id", "positive", "field", kind.alias("clause"), value.alias("value_json"), "value_kind").filter("clause IS NOT NULL")


def merged_clauses(local: DataFrame) -> DataFrame:
    """Clauses over all positives: (hyp_id, clause_id, clause, field, values).

    Constants with more distinct values than a constant may have become
    ``consistent``; booleans never do and stay one clause for each value.
    """
    constants = local.filter("positive AND clause = 'constant'").groupBy("hyp_id", "field").agg(
        F.sort_array(F.collect_set("value_json")).alias("values"), F.max("value_kind").alias("kind")
    )
    most = F.when(F.col("kind") == "str", MOST_STRINGS).otherwise(MOST_OTHERS)
    many = (F.size("values") > most) & (F.col("kind") != "bool")
    wide = constants.filter(many).select("hyp_id", F.lit("consistent").alias("clause"), "field", F.array().cast("array<string>").alias("values"))
    # every value alone, and all of them together where they are few
    alone = constants.filter(~many).select("hyp_id", F.lit("constant").alias("clause"), "field", F.explode("values").alias("v")).select("hyp_id", "clause", "field", F.array("v").alias("values"))
    together = constants.filter(~many & (F.size("values") > 1) & (F.col("kind") != "bool")).select("hyp_id", F.lit("constant").alias("clause"), "field", "values")
    rest = local.filter("positive AND clause IN ('unequal', 'exist')").select("hyp_id", "clause", "field", F.array().cast("array<string>").alias("values")).distinct()
    every = wide.unionByName(alone).unionByName(together).unionByName(rest)
    name = F.concat_ws("|", "clause", "field", F.array_join("values", ","))
    return every.select("hyp_id", name.alias("clause_id"), "clause", "field", "values")


def holds(clause: Column, values: Column, n_values: Column, n_records: Column, n_with: Column, all_in: Column) -> Column:
    """Does a clause hold for an example, from aggregates of its field."""
    full = n_with == n_records
    return F.when(clause == "exist", full).when(clause == "consistent", full & (n_values == 1)).when(clause == "unequal", full & (n_values == n_records)).otherwise(full & (n_values == 1) & all_in)


def evaluated(fields: DataFrame, clauses: DataFrame) -> DataFrame:
    """(hyp_id, example_id, positive, clause_id, holds): every clause of a hypothesis on every example of it."""
    size = fields.groupBy("hyp_id", "example_id", "positive").agg(F.count_distinct("record_pos").alias("n_records"))
    asked = size.join(clauses, "hyp_id")
    by_field = fields.filter("value_json IS NOT NULL").groupBy("hyp_id", "example_id", "field").agg(F.count_distinct("record_pos").alias("n_with"), F.collect_set("value_json").alias("own"))
    joined = asked.join(by_field, ["hyp_id", "example_id", "field"], "left")
    inside = F.size(F.array_except("own", "values")) == 0
    value = holds(F.col("clause"), F.col("values"), F.size("own"), F.col("n_records"), F.col("n_with"), inside)
    return joined.select("hyp_id", "example_id", "positive", "clause_id", F.coalesce(value, F.lit(False)).alias("holds"))


def base_clauses(tested: DataFrame) -> DataFrame:
    """Clauses that all positives meet, and whether a negative ever fails them (others say nothing)."""
    seen = tested.groupBy("hyp_id", "clause_id").agg(F.bool_and(F.when(F.col("positive"), F.col("holds"))).alias("in_all"), F.count_if(~F.col("positive") & ~F.col("holds")).alias("n_excluded"))
    return seen.filter("in_all").select("hyp_id", "clause_id", (F.col("n_excluded") > 0).alias("useful"))


def verdicts(tested: DataFrame) -> DataFrame:
    """Each hypothesis: ``unconditional`` without negatives, ``conjunction`` where the useful base clauses exclude all negatives, else ``search``."""
    useful = base_clauses(tested).filter("useful").select("hyp_id", "clause_id")
    negatives = tested.filter("NOT positive")
    passes = negatives.join(useful, ["hyp_id", "clause_id"]).groupBy("hyp_id", "example_id").agg(F.bool_and("holds").alias("passes"))
    n = tested.groupBy("hyp_id").agg(F.count_distinct(F.when(~F.col("positive"), F.col("example_id"))).alias("n_negative"))
    left = passes.groupBy("hyp_id").agg(F.count_if("passes").alias("n_passing"))
    kind = F.when(F.col("n_negative") == 0, "unconditional").when(F.col("n_passing") == 0, "conjunction").otherwise("search")
    return n.join(left, "hyp_id", "left").select("hyp_id", "n_negative", F.coalesce("n_passing", F.col("n_negative")).alias("n_passing"), kind.alias("verdict"))


def _inside(small: DataFrame, large: DataFrame) -> DataFrame:
    """(hyp_id, small, large): distinct sets of clauses (``hyp_id, clauses``, sorted) that lie in another, itself included.

    A set is entered under its rarest clause, and looked up with every clause of
    the other; the empty set lies in all.
    """
    few = small.select("hyp_id", F.col("clauses").alias("small")).distinct()
    many = large.select("hyp_id", F.col("clauses").alias("large")).distinct()
    own = few.select("hyp_id", "small", F.explode("small").alias("clause"))
    asked = many.select("hyp_id", "large", F.explode("large").alias("clause"))
    known = asked.groupBy("hyp_id", "clause").agg(F.count("*").alias("n"))
    rarest = own.join(known, ["hyp_id", "clause"], "left").groupBy("hyp_id", "small").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "clause"))["clause"].alias("clause"))
    found = rarest.join(asked, ["hyp_id", "clause"]).filter(F.size(F.array_except("small", "large")) == 0).select("hyp_id", "small", "large")
    return found.unionByName(few.filter(F.size("small") == 0).join(many, "hyp_id").select("hyp_id", "small", "large"))


def _sorted_sets(sets: DataFrame) -> DataFrame:
    return sets.select("hyp_id", "conj_id", F.array_sort(F.array_distinct("clauses")).alias("clauses"))


def implied(sets: DataFrame) -> DataFrame:
    """Conjunctions that a more general one of the same hypothesis makes needless: (hyp_id, conj_id).

    Sets of clauses are compared, each once, not conjunctions; of equal ones the
    smallest id stays.
    """
    s = _sorted_sets(sets)
    ids = s.groupBy("hyp_id", "clauses").agg(F.min("conj_id").alias("lo"), F.max("conj_id").alias("hi"))
    general = _inside(ids, ids).filter(F.size("small") < F.size("large")).join(ids.withColumnRenamed("clauses", "small"), ["hyp_id", "small"])
    below = general.groupBy("hyp_id", F.col("large").alias("clauses")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    known = ids.select("hyp_id", "clauses", F.col("lo").alias("least")).join(below, ["hyp_id", "clauses"], "left")
    me = F.col("conj_id")
    # another id than one's own: the least and the greatest are not both one's own
    needless = (F.col("least") < me) | F.coalesce((F.col("lo") != me) | (F.col("hi") != me), F.lit(False))
    return s.join(known, ["hyp_id", "clauses"]).filter(needless).select("hyp_id", "conj_id").distinct()


def unsafe(tested: DataFrame, sets: DataFrame) -> DataFrame:
    """(hyp_id, conj_id, example_id): negatives that meet every clause of a conjunction.

    Distinct sets of clauses met and asked for are compared; what is then joined
    are the result's own rows.
    """
    s = _sorted_sets(sets)
    met = tested.filter("NOT positive").groupBy("hyp_id", "example_id").agg(F.array_sort(F.collect_set(F.when(F.col("holds"), F.col("clause_id")))).alias("met"))
    pairs = _inside(s, met.select("hyp_id", F.col("met").alias("clauses")))
    # an example's set names the sets in it, so that one join by set makes the rows
    asked = met.join(pairs.select("hyp_id", F.col("large").alias("met"), F.col("small").alias("clauses")), ["hyp_id", "met"]).select("hyp_id", "example_id", "clauses")
    ids = s.groupBy("hyp_id", "clauses", F.pmod(F.xxhash64("conj_id"), F.lit(ID_LISTS)).alias("part")).agg(F.collect_list("conj_id").alias("ids"))
    return asked.join(ids, ["hyp_id", "clauses"]).select("hyp_id", F.explode("ids").alias("conj_id"), "example_id")


def search(table: pd.DataFrame, depth: int = MOST_DEPTH) -> list[list[str]] | None:
    """Disjunction of conjunctions that all positives and no negatives meet, or None.

    ``table``: clause_id columns, index (positive, example_id), booleans.  A set
    of positives takes the clauses that all of it meets and that exclude some
    negative; where negatives pass, it is split by the clause that excludes most
    of them, and both parts go on.
    """
    positives, negatives = table[table.index.get_level_values(0)], table[~table.index.get_level_values(0)]
    found: list[list[str]] = []

    def solve(rows: pd.DataFrame, level: int) -> bool:
        common = [c for c in rows.columns if rows[c].all() and not negatives[c].all()]
        passing = negatives[negatives[common].all(axis=1)] if common else negatives
        if passing.empty:
            short, left = [], negatives
            for c in sorted(common, key=lambda c: (negatives[c].sum(), c)):
                if left.empty:
                    break
                if not left[c].all():
                    short.append(c)
                    left = left[left[c]]
            if sorted(short) not in found:
                found.append(sorted(short))
            return True
        if level == 0:
            return False
        splits = [(-(~passing[c]).sum(), -rows[c].sum(), c) for c in rows.columns if rows[c].any() and not rows[c].all() and not passing[c].all()]
        for _, _, c in sorted(splits):
            kept = len(found)
            if solve(rows[rows[c]], level - 1) and solve(rows[~rows[c]], level - 1):
                return True
            del found[kept:]
        return False

    if positives.empty:
        return None
    if negatives.empty:
        return []
    if not solve(positives, depth):
        return None
    # a conjunction that a more general one implies is needless
    return [c for c in found if not any(set(d) < set(c) for d in found)]


def learned(tested: DataFrame, inverted: bool = True) -> DataFrame:
    """(hyp_id, status, inverted, precondition JSON): the search for every hypothesis.

    One task holds the examples of one hypothesis, which ``capped`` bounds.
    ``inverted``: where nothing is found, the same with positives and negatives
    exchanged.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        hyp = pdf["hyp_id"].iloc[0]
        for turned in (False, True) if inverted else (False,):
            label = ~pdf["positive"] if turned else pdf["positive"]
            table = pdf.assign(positive=label.astype(bool)).pivot_table(index=["positive", "example_id"], columns="clause_id", values="holds", aggfunc="all", fill_value=False).astype(bool)
            found = search(table)
            if found == []:
                return pd.DataFrame([(hyp, "unconditional", turned, json.dumps("Unconditional"))], columns=["hyp_id", "status", "inverted", "precondition"])
            if found is not None:
                return pd.DataFrame([(hyp, "conditional", turned, json.dumps(found))], columns=["hyp_id", "status", "inverted", "precondition"])
        return pd.DataFrame([(hyp, "failed", False, None)], columns=["hyp_id", "status", "inverted", "precondition"])

    rows = tested.select("hyp_id", "example_id", "positive", "clause_id", "holds")
    return rows.groupBy("hyp_id").applyInPandas(run, f"hyp_id {dict(tested.dtypes)['hyp_id']}, status string, inverted boolean, precondition string")


def satisfied(tested: DataFrame, conditions: DataFrame) -> DataFrame:
    """(hyp_id, example_id, positive, satisfied): does each example meet its hypothesis' precondition."""
    dnf = conditions.select("hyp_id", "inverted", F.from_json("precondition", "array<array<string>>").alias("dnf"))
    true = tested.groupBy("hyp_id", "example_id", "positive").agg(F.collect_set(F.when(F.col("holds"), F.col("clause_id"))).alias("true"))
    met = F.when(F.col("dnf").isNull(), True).otherwise(F.exists("dnf", lambda c: F.size(F.array_except(c, F.col("true"))) == 0) != F.col("inverted"))
    return true.join(dnf, "hyp_id").select("hyp_id", "example_id", "positive", met.alias("satisfied"))


def with_stages(conditions: DataFrame, stages: DataFrame) -> DataFrame:
    """Adds a constant clause of the valid stages to every conjunction: ``stages(hyp_id, stages)``."""
    clause = F.concat(F.lit("constant|meta_vars.stage|"), F.array_join(F.sort_array("stages"), ","))
    dnf = F.from_json("precondition", "array<array<string>>")
    plain = F.when(dnf.isNull(), F.array(F.array(clause))).otherwise(F.transform(dnf, lambda c: F.array_append(c, clause)))
    return conditions.join(stages, "hyp_id").withColumn("precondition", F.to_json(plain)).drop("stages")


def with_contexts(fields: DataFrame, active: DataFrame) -> DataFrame:
    """Adds the contexts active at an example's first record to each of its records: ``active(example_id, field, value_json)``."""
    records = fields.select("hyp_id", "example_id", "positive", "record_pos").distinct()
    return fields.unionByName(records.join(active, "example_id").select("hyp_id", "example_id", "positive", "record_pos", "field", "value_json"))
