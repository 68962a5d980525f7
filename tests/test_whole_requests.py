"""Queries of requests over every block of a prompt, against SQL without a bound on blocks."""

import pytest
from comparison import SMALL, duck_rows, spark_rows

from tessera import plans
from tessera.plans.prefixes import KNOWN, MATCH
from tessera.plans.tables import BLK, REQ

plans.load()
BID = "bid AS (SELECT *, list_transform(range((n_tokens + 3) // 4), lambda i: i * 2 + conv_id) AS block_ids FROM lp)"
WHOLE = {
    "slot_mapping": f"""WITH {REQ}, p AS (SELECT request, conv_id, unnest(range(len(tokens))) AS pos FROM req)
SELECT request, pos, ((conv_id + pos // 4 * 3) * 4 + pos % 4)::BIGINT AS slot FROM p""",
    "load_specs": f"""WITH {REQ}, {BLK}, {KNOWN}, {MATCH}, {BID}
SELECT request, matched // 4 AS n_blocks, array_to_string(block_ids[1:matched // 4], ',') AS blocks FROM bid WHERE matched >= 4""",
    "store_specs": f"""WITH {REQ}, {BLK}, {KNOWN}, {MATCH}
SELECT request, n_tokens // 4 AS need, conv_id % 5 = 4 AND turn % 2 = 1 AS deferred FROM lp WHERE n_tokens // 4 > 0 AND matched < n_tokens // 4 * 4""",
}


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_every_block_counts(spark, name):
    names, rows = spark_rows(plans.QUERIES[name](spark, SMALL))
    assert (names, rows) == duck_rows(WHOLE[name])
    if name == "slot_mapping":
        assert max(r[names.index("pos")] for r in rows) > 12
    if name == "load_specs":
        assert max(r[names.index("n_blocks")] for r in rows) > 3
    if name == "store_specs":
        assert {r[names.index("deferred")] for r in rows} == {False, True}
