from skylattice.operators import itineraries, network
from skylattice.sources import derived

SF = "/root/testdata/sf0.001"
FIELDS = ["company", "number", "origin", "dest", "dep", "arr", "block"]


def test_itineraries_carry_the_fields_asked_for_only(spark):
    f, a = derived.flights(spark, SF), derived.airports(spark, SF)
    path = itineraries.paths(network.edges(f, a), network.siblings(a), 2)
    found = itineraries.along(path, f, a, 2, fields=FIELDS)
    assert found.schema["flights"].dataType.elementType.names == FIELDS
    key = ["edges", "circuity", "transfers", "transfer_time", "travel", "flown", "airports"]
    rows = lambda x: sorted(map(repr, x.select(*key).collect()))
    assert rows(found) == rows(itineraries.along(path, f, a, 2)) != []
