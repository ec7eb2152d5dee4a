import pytest
from pyspark.sql import functions as F

from packetloom.functions import labels
from packetloom.functions.services import service_name


@pytest.mark.parametrize(
    "proto, port, kind, code, name",
    [
        ("tcp", 80, -1, -1, "http"), ("tcp", 443, -1, -1, "http_443"), ("tcp", 21, -1, -1, "ftp"), ("tcp", 22, -1, -1, "ssh"),
        ("tcp", 23, -1, -1, "telnet"), ("tcp", 6667, -1, -1, "IRC"), ("tcp", 54321, -1, -1, "private"),
        ("udp", 53, -1, -1, "domain_u"), ("udp", 123, -1, -1, "ntp_u"), ("udp", 54321, -1, -1, "private"),
        ("icmp", 0, 8, 0, "eco_i"), ("icmp", 0, 0, 0, "ecr_i"), ("icmp", 0, 3, 3, "urp_i"), ("icmp", 0, 3, 1, "urh_i"),
        ("icmp", 0, 42, 0, "oth_i"), ("sctp", 80, -1, -1, "other"),
    ],
)
def test_services(spark, proto, port, kind, code, name):
    row = spark.range(1).select(service_name(F.lit(proto), F.lit(port), F.lit(kind), F.lit(code)).alias("s")).first()
    assert row.s == name


def label_frame(spark, names):
    return spark.createDataFrame([(n,) for n in names], "label string")


def test_attack_classes(spark):
    names = ["normal", "neptune", "satan", "guess_passwd", "rootkit", "novel"]
    got = labels.with_attack_class(label_frame(spark, names)).collect()
    assert [(r.label, r.category, r.class_index) for r in got] == [
        ("normal", "normal", 0), ("neptune", "dos", 1), ("satan", "probe", 2), ("guess_passwd", "r2l", 3),
        ("rootkit", "u2r", 4), ("novel", None, None),
    ]
    assert len(labels.ATTACK_CATEGORY) == 40


def test_unknown_labels_fail_in_order(spark):
    with pytest.raises(labels.UnknownLabelError, match="a_new, z_new"):
        labels.require_known(labels.unknown_attack_labels(label_frame(spark, ["z_new", "normal", "a_new", "z_new"])))
    labels.require_known(labels.unknown_attack_labels(label_frame(spark, ["normal", "back"])))


def test_flow_labels(spark):
    names = [" BENIGN", "DoS Hulk", "PortScan\t", "SSH-Patator", "Web Attack \x96 XSS", "Bot", "Heartbleed", "Odd"]
    got = labels.with_flow_class(label_frame(spark, names)).collect()
    assert [r.class_index for r in got] == [0, 1, 2, 3, 4, 5, 6, None]
    binary = label_frame(spark, names).select(labels.binary_flow_label(F.col("label")).alias("b")).collect()
    assert [r.b for r in binary] == [0, 1, 1, 1, 1, 1, 1, 1]
    assert [r.label for r in labels.unknown_flow_labels(label_frame(spark, names)).collect()] == ["Odd"]
