from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

from countinghouse.plans import generate


def test_lists_of_eligible_employees(spark, shop):
    hired = [(n, f"e{n}", 1 + n % 2, "Cashier", date(2024, 1, 1 + (n * 7) % 20), Decimal(0)) for n in range(9)]
    dated = [
        (500 + n, None, 1, 1 + n % 3, datetime(2024, 1, 1 + n % 22, 12), "Cash", Decimal(0))
        for n in range(60)
    ]
    t = {
        **shop,
        "employees": spark.createDataFrame(hired, shop["employees"].schema),
        "sales": spark.createDataFrame(dated, shop["sales"].schema),
    }
    staff = generate.roster(t)
    lists = generate.eligible_lists(t, staff)
    found = {row.sale_id: [] for row in lists.collect()}
    for row in generate.expanded(lists, staff).orderBy("sale_id", "position").collect():
        found[row.sale_id].append(row.employee_id)
        assert row.position == len(found[row.sale_id])
    wanted = {
        sale[0]: [x[0] for x in sorted(hired, key=lambda x: (x[4], x[0]))
                  if x[2] == sale[3] and x[4] <= sale[4].date()]
        for sale in dated
    }
    assert found == wanted and any(len(x) > 2 for x in found.values()) and [] in found.values()
    for row in lists.collect():
        ids = wanted[row.sale_id]
        assert row.eligible_employees == len(ids)
        assert row.list_hash == sum(n * (x * 7919 % 1_000_003) for n, x in enumerate(ids, 1))
    counts = {r.sale_id: r.eligible_employees for r in generate.eligible_employees(t).collect()}
    assert counts == {sale: len(ids) for sale, ids in wanted.items()}


def test_lists_for_no_employees(shop, nothing):
    lists = generate.eligible_lists({**shop, "employees": nothing["employees"]})
    assert {row.eligible_employees for row in lists.collect()} == {0}
    assert generate.eligible_lists(nothing).count() == 0
