"""Label vocabularies and the columns derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.functions.literals import literal_array, literal_map

# Attack name -> category, and the category order.
ATTACK_CATEGORY = {
    "normal": "normal",
    "back": "dos", "land": "dos", "neptune": "dos", "pod": "dos",
    "smurf": "dos", "teardrop": "dos", "apache2": "dos", "udpstorm": "dos",
    "processtable": "dos", "mailbomb": "dos", "worm": "dos",
    "satan": "probe", "ipsweep": "probe", "nmap": "probe",
    "portsweep": "probe", "mscan": "probe", "saint": "probe",
    "guess_passwd": "r2l", "ftp_write": "r2l", "imap": "r2l", "phf": "r2l",
    "multihop": "r2l", "warezmaster": "r2l", "warezclient": "r2l",
    "spy": "r2l", "xlock": "r2l", "xsnoop": "r2l", "snmpguess": "r2l",
    "snmpgetattack": "r2l", "httptunnel": "r2l", "sendmail": "r2l",
    "named": "r2l",
    "buffer_overflow": "u2r", "loadmodule": "u2r", "rootkit": "u2r",
    "perl": "u2r", "sqlattack": "u2r", "xterm": "u2r", "ps": "u2r",
}
ATTACK_CLASSES = ["normal", "dos", "probe", "r2l", "u2r"]

# Flow-file label -> category, the prefix rule, and the order.
FLOW_CATEGORY = {
    "BENIGN": "benign",
    "DDoS": "dos",
    "DoS Hulk": "dos",
    "DoS GoldenEye": "dos",
    "DoS slowloris": "dos",
    "DoS Slowhttptest": "dos",
    "PortScan": "portscan",
    "FTP-Patator": "bruteforce",
    "SSH-Patator": "bruteforce",
    "Bot": "botnet",
    "Infiltration": "other",
    "Heartbleed": "other",
}
WEB_ATTACK_PREFIX = "Web Attack"
FLOW_CLASSES = ["benign", "dos", "portscan", "bruteforce", "webattack", "botnet", "other"]

BINARY_CLASSES = ["normal", "attack"]


class UnknownLabelError(ValueError):
    """Raised when rows carry labels outside the vocabulary."""


def trimmed(label: Column) -> Column:
    """Strip every kind of white space, tabs included."""
    return F.regexp_replace(label, r"^\s+|\s+$", "")


def attack_label_table(spark: SparkSession) -> DataFrame:
    """label, category, class_index: one row per known attack name (40 rows)."""
    rows = [(name, cat, ATTACK_CLASSES.index(cat)) for name, cat in ATTACK_CATEGORY.items()]
    return spark.createDataFrame(rows, "label string, category string, class_index int")


def _category(label: Column, mapping: dict[str, str]) -> Column:
    return F.try_element_at(literal_map(mapping), label)


def attack_category(label: Column) -> Column:
    """Category name, null when the label is unknown."""
    return _category(label, ATTACK_CATEGORY)


def flow_category(label: Column) -> Column:
    """Category name of a flow-file label, null when unknown."""
    name = trimmed(label)
    return F.coalesce(
        _category(name, FLOW_CATEGORY), F.when(name.startswith(WEB_ATTACK_PREFIX), F.lit("webattack"))
    )


def class_index(category: Column, classes: list[str]) -> Column:
    """0-based position of a category in ``classes``, null for null."""
    return F.nullif(F.array_position(literal_array(classes), category).cast("int"), F.lit(0)) - 1


def binary_label(label: Column) -> Column:
    return (label != "normal").cast("int")


def binary_flow_label(label: Column) -> Column:
    return (trimmed(label) != "BENIGN").cast("int")


def with_attack_class(df: DataFrame, label: str = "label") -> DataFrame:
    """Add ``category`` and ``class_index``; both null for unknown labels."""
    category = attack_category(F.col(label))
    return df.withColumn("category", category).withColumn(
        "class_index", class_index(F.col("category"), ATTACK_CLASSES)
    )


def with_flow_class(df: DataFrame, label: str = "label") -> DataFrame:
    category = flow_category(F.col(label))
    return df.withColumn("category", category).withColumn(
        "class_index", class_index(F.col("category"), FLOW_CLASSES)
    )


def unknown_attack_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """Distinct labels outside the vocabulary; an empty result means all are known."""
    names = df.select(F.col(label).alias("label")).distinct()
    known = F.broadcast(attack_label_table(df.sparkSession).select("label"))  # 40 rows
    return names.join(known, "label", "left_anti")


def unknown_flow_labels(df: DataFrame, label: str = "label") -> DataFrame:
    names = df.select(trimmed(F.col(label)).alias("label")).distinct()
    return names.where(flow_category(F.col("label")).isNull())


def require_known(unknown: DataFrame) -> None:
    """Fail naming all unknown labels (distinct names, so few) in order."""
    rows = unknown.orderBy("label").collect()
    if rows:
        raise UnknownLabelError(f"no category is known for these labels: {', '.join(str(r.label) for r in rows)}")


def prediction_columns(prediction: Column, classes: list[str]) -> dict[str, Column]:
    """Class name and attack flag of a class index."""
    index = prediction.cast("int")
    return {
        "prediction": index,
        "label": F.element_at(literal_array(classes), index + 1),
        "is_attack": index != 0,
    }
