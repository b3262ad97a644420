"""Licence detection with a positional index of licence words."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pointlake.llm.common import ascii_lower, ids_and_texts, session, staged

# The base phrases and their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

# Licence notices as their licences word them: (label, notice, phrases that must be there).
NOTICES = [
    ("apache", "licensed under the apache license version 2 0", ["licensed under the apache license"]),
    ("apache", "you may not use this file except in compliance with the license", ["in compliance with the license"]),
    ("apache", "spdx license identifier apache 2 0", ["license identifier apache"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["source and binary forms"]),
    ("cc", "this work is licensed under a creative commons attribution license", ["creative commons attribution"]),
    ("cc-by", "licensed under cc by 4 0", ["licensed under cc by 4 0"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["licensed under cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["licensed under cc by sa"]),
    ("gpl", "this work is licensed under the gnu general public license version 3", ["gnu general public license"]),
    ("gpl", "under the terms of the gnu general public license", ["gnu general public license"]),
    ("lgpl", "under the terms of the gnu lesser general public license", ["lesser general public license"]),
    ("mit", "released under the mit license", ["under the mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ["permission is hereby granted"]),
    ("mit", "spdx license identifier mit", ["license identifier mit"]),
    ("mpl", "subject to the terms of the mozilla public license", ["mozilla public license"]),
]
#: Words too common to be looked up; they still count as words between the others.
COMMON = {"a", "and", "any", "are", "by", "except", "file", "in", "is", "may", "not", "of", "or", "person", "the", "this", "to", "under", "use", "with", "without", "work", "you"}
#: Share of a notice's indexed words that must stand at their places.
LEAST_SHARE = 0.6
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def postings() -> list[tuple[int, str, str, int, int, int, int, bool]]:
    """(notice, label, word, place, indexed words, must-be-there words, must, base) for each indexed word of a notice."""
    out = []
    for k, (label, text, phrases) in enumerate([(label, phrase, [phrase]) for phrase, label in PHRASES] + NOTICES):
        words = text.split()
        must = set()
        for phrase in phrases:
            want = phrase.split()
            at = next(i for i in range(len(words)) if words[i : i + len(want)] == want)
            must.update(range(at, at + len(want)))
        indexed = [i for i, w in enumerate(words) if w not in COMMON]
        needed = [i for i in indexed if i in must]
        out += [(k, label, words[i], i, len(indexed), len(needed), int(i in must), k < len(PHRASES)) for i in indexed]
    return out


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) per row.

    One pass over the texts keeps the positions of licence words only. Every notice is posted under that of its mandatory
    words which fewest documents have; a document looks up all its licence words and is held against the notices posted
    there, however many. Postings and positions meet at the place where a notice would start, and it holds if its mandatory
    words and ``LEAST_SHARE`` of its indexed words stand there. Base phrases must stand complete. ``score`` is the largest share
    of an accepted notice, 0 without any. Null and empty texts have no words; ``first_word``, ``last_word`` are null
    where no base phrase is; repeated rows each give a row, a null id stays null, an empty table gives none; other columns are
    never read. A common word between two indexed ones may be any word, except in base phrases, which have none.
    """
    spark = session(df)
    table = spark.sql(
        "SELECT * FROM VALUES " + ", ".join(str(p) for p in postings())
        + " AS postings(notice, label, word, place, n_indexed, n_must, must, base)"
    )
    vocabulary = sorted({p[2] for p in postings()})
    known = F.array(*map(F.lit, vocabulary))
    rows = ids_and_texts(df, id_col, text_col).select(
        "doc_id", F.filter(F.split(ascii_lower(F.col("text")), SEPARATORS), lambda w: w != "").alias("words")
    )
    hits = F.filter(
        F.transform("words", lambda w, i: F.struct(i.cast("long").alias("at"), w.alias("word"))), lambda h: h["word"].isin(vocabulary)
    )
    docs = staged(rows.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), F.array_intersect("words", known).alias("has"),
        F.when(F.arrays_overlap("words", known), hits).alias("hits"), F.monotonically_increasing_id().alias("row"),
    ))
    # As many rows as the catalogue has words.
    seen = dict(docs.select(F.explode("has").alias("word")).groupBy("word").count().collect())
    posted: dict[str, list[int]] = {}
    for notice in sorted({p[0] for p in postings()}):
        rarest = min((seen.get(p[2], 0), p[2]) for p in postings() if p[0] == notice and p[6])[1]
        posted.setdefault(rarest, []).append(notice)
    looked_up = F.concat(*(F.when(F.array_contains("has", w), F.array(*map(F.lit, held))).otherwise(F.array().cast("array<int>")) for w, held in posted.items()))
    places = docs.withColumn("candidates", looked_up).where(F.size("candidates") > 0)
    places = places.select("row", "candidates", F.explode("hits").alias("hit")).select("row", "candidates", "hit.word", "hit.at")
    met = places.join(F.broadcast(table), "word").where(F.array_contains("candidates", F.col("notice"))).withColumn("start", F.col("at") - F.col("place"))
    found = met.groupBy("row", "notice", "start").agg(
        F.first("label").alias("label"), F.first("base").alias("base"), (F.count(F.lit(1)) / F.first("n_indexed")).alias("share"),
        (F.sum("must") == F.first("n_must")).alias("whole"),
    ).where((F.col("start") >= 0) & F.col("whole") & (F.col("share") >= LEAST_SHARE))
    per_row = found.groupBy("row").agg(
        F.count(F.when(F.col("base"), 1)).alias("n_base"), F.min(F.when(F.col("base"), F.col("start"))).alias("first_word"),
        F.max(F.when(F.col("base"), F.col("start"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("share").alias("score"),
    )
    return docs.select("row", "doc_id", "n_words").join(per_row, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).cast("double").alias("score"),
    )


def oracle(documents: str) -> str:
    """The same rows in DuckDB SQL."""
    values = ", ".join(str(p) for p in postings())
    return f"""
WITH t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '{SEPARATORS}'), lambda w: w <> '') AS words, row_number() OVER () AS row FROM {documents}),
p(notice, label, word, place, n_indexed, n_must, must, base) AS (VALUES {values}),
w AS (SELECT row, unnest(words) AS word, unnest(range(len(words))) AS pos FROM t),
h AS (SELECT * FROM w WHERE word IN (SELECT word FROM p)),
f AS (
  SELECT row, notice, pos - place AS start, any_value(label) AS label, any_value(base) AS base, count(*) / any_value(n_indexed) AS share
  FROM h JOIN p USING (word) GROUP BY row, notice, start
  HAVING sum(must) = any_value(n_must) AND share >= {LEAST_SHARE} AND start >= 0),
a AS (
  SELECT row, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
    array_to_string(list_sort(list_distinct(list(label) FILTER (base))), ',') AS base_labels,
    array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, max(share) AS score
  FROM f GROUP BY row)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
  CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM t LEFT JOIN a USING (row)
"""
