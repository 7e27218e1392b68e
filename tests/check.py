"""Run registered queries against their SQL: python tests/check.py SF_DIR [name...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from tests.oracle import connect, differences  # noqa: E402


def main() -> None:
    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "8")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sqls = entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            df = run(spark, sf_dir)
            if name in sqls:
                found = differences(df, con, sqls[name])
                n = con.execute(f"SELECT count(*) FROM ({sqls[name]})").fetchone()[0]
            else:
                n, found = df.count(), []
        except Exception as e:  # report and go on
            n, found = -1, [f"{type(e).__name__}: {str(e)[:600]}"]
        bad += bool(found)
        print(f"{'BAD' if found else 'ok '} {name:28s} {time.time() - t0:6.1f}s rows={n} {'' if name in sqls else '(rows only)'} {found or ''}", flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main()
