"""Questions answered from stored sums against the same over the lines."""

import random
from itertools import chain

import pytest
from pyspark.sql import functions as F

from tillroll.operators import lattice as L
from tillroll.operators import sales as S
from tillroll.operators.common import sum_by
from tillroll.session import scratch_path

DIMS = ("year", "center_name", "item_type", "item_category", "business_unit")


@pytest.fixture(scope="module")
def built(spark, lines):
    # some null dimension values and measures
    dirty = lines.withColumns({
        "business_unit": F.when(F.col("invoice_no") % 5 != 0, F.col("business_unit")),
        "item_type": F.when(F.col("invoice_no") % 7 != 0, F.col("item_type")),
        "sales_inc_tax": F.when(F.col("invoice_no") % 3 != 0, F.col("sales_inc_tax"))})
    at = scratch_path(spark, "lattice")
    return dirty, L.build_lattice(dirty, at, DIMS, tables=5), at


def rows(df):
    return sorted(map(str, df.collect()))


def test_questions_equal_those_over_lines(built):
    lines, lattice, _ = built
    rng = random.Random(5)
    values = {d: [r[0] for r in lines.select(d).distinct().orderBy(d).limit(4).collect() if r[0] is not None] for d in DIMS}
    read = set()
    for _ in range(12):
        keys = rng.sample(DIMS, rng.randint(1, 2))
        filters = {d: rng.choice(["All", None, values[d][0], values[d][:2]]) for d in rng.sample(DIMS, rng.randint(0, 3))}
        table = lattice.lines_for(keys, filters)
        read.add(frozenset(table.columns))
        from tillroll.operators.common import apply_filters
        for measure in ("inc_tax", "exc_tax"):
            assert rows(sum_by(apply_filters(table.drop("sale_date"), filters), keys, measure, "s")) == \
                rows(sum_by(apply_filters(lines.drop("sale_date"), filters), keys, measure, "s")), (keys, filters)
        assert rows(S.mix(table, keys[0], filters=filters)) == rows(S.mix(lines.drop("sale_date"), keys[0], filters=filters))
    assert len(read) > 1
    assert rows(S.top_pairs(lattice.lines_for(DIMS[3:]), list(DIMS[3:]), 7)) == rows(S.top_pairs(lines, list(DIMS[3:]), 7))


def test_lines_are_counted(built):
    lines, lattice, _ = built
    for s in lattice.rows:
        assert lattice.table(s).agg(F.sum("lines")).first()[0] == lines.count()


def test_reopened(spark, built):
    _, lattice, at = built
    again = L.open_lattice(spark, at)
    assert again.rows == lattice.rows
    with pytest.raises(ValueError):
        again.smallest(["no_such_column"])


def test_sizes_are_close(built):
    lines, lattice, _ = built
    base = lattice.table(frozenset(DIMS))
    for s, n in L.estimate_rows(base, DIMS).items():
        if s:
            true = base.select(*sorted(s)).distinct().count()
            assert abs(n - true) <= max(2, 0.15 * true), sorted(s)


def test_choice_is_greedy_and_brute_force_agrees():
    """Against the definition: each step tries every set and counts the rows saved."""
    rng = random.Random(2)
    sets = L.subsets("abcd")
    rows = {s: 1 if not s else rng.randint(2, 50) * len(s) for s in sets}
    rows[frozenset("abcd")] = 1000
    got = L.choose(rows, 4)
    chosen = [frozenset("abcd")]

    def cost(c):
        return sum(min(rows[s] for s in c if q <= s) for q in sets)
    for _ in range(4):
        best = min(cost(chosen + [s]) for s in sets if s not in chosen)
        step = got[len(chosen)]
        assert cost(chosen + [step]) == best
        chosen.append(step)
    assert L.choose(rows, 9, {frozenset("a"): 1.0})[1:] == [min((s for s in sets if "a" in s), key=lambda s: rows[s])]
    assert set(chain(*got)) == set("abcd")


def test_empty_lines(spark, lines):
    lattice = L.build_lattice(lines.limit(0), scratch_path(spark, "lattice"), DIMS[:2], tables=1)
    assert sum_by(lattice.lines_for(["year"]), ["year"], "inc_tax", "s").collect() == []
