"""Map layers are published independently."""

from tidewatch.operators.views import layer_status
from tidewatch.plans.layers import layer_table, publish_layers, read_layer


def test_a_failing_layer_keeps_its_previous_version(spark, folder):
    def down():
        raise RuntimeError("provider down")

    assert read_layer(spark, folder, "aircraft") is None
    assert publish_layers(spark, folder, {"hosts": down, "aircraft": lambda: spark.range(3)}, 1_000) == ["hosts"]
    assert publish_layers(spark, folder, {"aircraft": down, "hosts": lambda: spark.range(2)}, 400_000) == ["aircraft"]
    assert read_layer(spark, folder, "aircraft").count() == 3
    states = {r["name"]: (r["rows"], r["state"]) for r in layer_status(layer_table(spark, folder), 400_000).collect()}
    assert states == {"aircraft": (3, "stale"), "hosts": (2, "current")}
