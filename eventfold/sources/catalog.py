"""Schema catalog: which schema id stands for which record type."""

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from eventfold.schemas import NULLABLE, RECORDS, TYPE_OF, full_name

# Schema ids in order of registration.
SCHEMA_IDS = {
    "Chaser": 1,
    "Aggregate": 2,
    "Bill": 3,
    "PaymentRequest": 4,
    "PaymentFailed": 5,
    "BillAggregate": 6,
}

_AVRO = {T.StringType(): "string", T.LongType(): "long", T.BooleanType(): "boolean"}


def _avro_type(data_type, namespace):
    if isinstance(data_type, T.ArrayType):
        return {"type": "array", "items": _avro_type(data_type.elementType, namespace)}
    if isinstance(data_type, T.StructType):
        kind = next(kind for kind, record in TYPE_OF.items() if record == data_type)
        return json.loads(avro_schema(kind, namespace))
    return _AVRO[data_type]


def avro_schema(kind: str, namespace: str = "events") -> str:
    """Avro schema of a record type, nullable fields as a union with null first."""
    fields = []
    for field in TYPE_OF[kind]:
        avro = _avro_type(field.dataType, namespace)
        nullable = field.name in NULLABLE.get(kind, ())
        fields.append({"name": field.name, "type": ["null", avro] if nullable else avro})
    space, _, name = full_name(kind, namespace).rpartition(".")
    return json.dumps({"type": "record", "name": name, "namespace": space, "fields": fields})


def schema_catalog(
    spark: SparkSession, topic: str, ids: dict[str, int] = SCHEMA_IDS, namespace: str = "events"
) -> DataFrame:
    """``kind, full_name, subject, schema_id, schema_json``, one row per record type."""
    rows = [
        (kind, name, f"{topic}-{name}", ids[kind], avro_schema(kind, namespace))
        for kind, _, _, _ in RECORDS
        if kind in ids
        for name in [full_name(kind, namespace)]
    ]
    schema = "kind string, full_name string, subject string, schema_id int, schema_json string"
    return checked(spark.createDataFrame(rows, schema))


def checked(catalog: DataFrame) -> DataFrame:
    """The catalog itself; raises if a type or an id is registered twice."""
    for column in ("full_name", "schema_id"):
        twice = catalog.groupBy(column).count().where("count > 1").take(1)
        if twice:
            raise ValueError(f"{column} {twice[0][0]} is registered twice")
    return catalog
