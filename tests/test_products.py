from tests.rows import action, actions, values
from visitlens import schemas
from visitlens.operators.products import area_top3_product


def test_area_top3(spark):
    clicks = [(1, 10)] * 5 + [(2, 10)] * 2 + [(1, 11)] * 3 + [(11, 12)] * 3 + [(2, 13)] * 3
    clicks += [(2, 99)] * 50 + [(77, 10)] * 50 + [(3, 14)]
    acts = actions(
        spark,
        *[action("s", i, click_product_id=p, city_id=c) for i, (c, p) in enumerate(clicks)],
        action("s", 0, city_id=1),
    )
    cities = spark.createDataFrame(
        [(1, "B", "north"), (2, "A", "north"), (11, "C", "north"), (3, "D", "south")],
        schemas.CITY_INFO,
    )
    products = spark.createDataFrame(
        [(p, f"product{p}", f'{{"product_status": {p % 2}}}') for p in (10, 11, 12, 13, 14)],
        schemas.PRODUCT_INFO,
    )
    got = area_top3_product(acts, cities, products, {"north": "A"}, "Z", 4)
    assert values(got) == [
        (4, "north", "A", 10, "1:B,2:A", 7, "product10", "0"),
        (4, "north", "A", 11, "1:B", 3, "product11", "1"),
        (4, "north", "A", 12, "11:C", 3, "product12", "0"),
        (4, "south", "Z", 14, "3:D", 1, "product14", "0"),
    ]
