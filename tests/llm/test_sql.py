"""The subpackage's queries against their DuckDB SQL, on the smallest tables and on odd texts."""

import brute
import duckdb
import pytest

from tessera.llm import queries

ODD = [*brute.ODD, *brute.ODD, "offff fluff abc", "a\x0cb \x0b c\rd", "fff\nfff\nx", "\x0c\n\x0c\nx", "one two three four five six seven eight nine " * 6, "z" * 350, "#$%& WORDS! " * 12]


def odd_tables(spark, folder):
    frame = spark.createDataFrame([(i, t, [None, "en", "de"][i % 3], ["src0", None, "src3"][i // 2 % 3]) for i, t in enumerate(ODD)], "doc_id long, text string, lang string, source string")
    frame.coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
@pytest.mark.parametrize("odd", [False, True])
def test_same_rows(spark, sf_dir, tmp_path, name, odd):
    folder, files = (odd_tables(spark, str(tmp_path)), "/*.parquet") if odd else (sf_dir, "")
    duck = duckdb.connect()
    for t in ("documents", "labels"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet{files}'")
    want = duck.execute(queries.ORACLE_SQL[name])
    names = sorted(d[0] for d in want.description)
    rows = want.fetchdf().astype(object).where(lambda x: x.notna(), None)
    got = queries.QUERIES[name](spark, folder)
    assert sorted(got.columns) == names
    as_rows = lambda data: sorted(str([r[n] for n in names]) for r in data)
    assert as_rows(r.asDict() for r in got.collect()) == as_rows(rows.to_dict("records"))


def test_rollup_of_tokenizers(spark, sf_dir, tmp_path):
    """Operator 6 against the tokenizers library, text by text."""
    for folder in (sf_dir, odd_tables(spark, str(tmp_path))):
        rows = queries.table(spark, folder, "documents").collect()
        want = {}
        for name, version in ((queries.BYTE_TOKENIZER, "bytes-50k"), (queries.WORD_TOKENIZER, "words-49k")):
            own = [r for r in rows if (r["lang"] == "de") == (version == "words-49k") and r["source"] != "src3"]
            for r, ids in zip(own, brute.ids_of(name, [r["text"] for r in own])):
                key = (r["source"], r["lang"], version)
                n, m = want.get(key, (0, 0))
                want[key] = (n + 1, m + len(ids) - 1)
        got = queries.op6_token_rollup(spark, folder).collect()
        assert {(r["source"], r["lang"], r["version"]): (r["n_docs"], r["n_tokens"]) for r in got} == want
