"""Small changelogs: ``log(spark, "a#9 b#8D")`` has a write of a at 9 and a tombstone of b at 8."""

from ledgerlake.schema import CHANGELOG, DELETE, SET


def log(spark, spec):
    rows = []
    for item in spec.replace(",", " ").split():
        key, _, rest = item.partition("#")
        rest, _, value = rest.partition("=")
        dead = rest.endswith("D")
        seq = int(rest.rstrip("D"))
        rows.append((bytearray(key.encode()), seq, DELETE if dead else SET, None if dead else bytearray((value or f"v{seq}").encode())))
    return spark.createDataFrame(rows, CHANGELOG)


def show(df):
    """Rows as sorted items of the same notation."""
    return sorted(f"{bytes(r['key']).decode()}#{r['seq']}{'D' if r['kind'] == DELETE else ''}" for r in df.collect())


def items(spec):
    return sorted(spec.replace(",", " ").split())
