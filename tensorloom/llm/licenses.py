"""License scans by diagonal voting.

Every rolling k-gram of a text's words is joined by its hash, and then by its words, to the places of the templates that hold it. A place in the text less the
place in the template is a diagonal: words that stand as in the template vote for one diagonal. Votes are summed by (text, template, diagonal); diagonals at
most SLIP apart, as an added or dropped word makes them, are one span; and a span counts when the words that its votes prove cover enough of the template
within a stretch of the text that is not much longer. Phrases count only where all their words stand on one diagonal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tensorloom.llm.common import give_back

# fixed values: phrases and notices of public licenses, in lower-case words, with the label each stands for
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
NOTICES = (
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "lgpl"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa-4.0"),
    ("released under the mit license", "mit-notice"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit-notice"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)
# bytes of words, A-Z in lower case; all other ASCII parts words
FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))

GRAM = 4
SLIP = 3
LEAST_COVER = 0.8
#: grams of a row that goes from a Python worker to Spark
PIECE = 20_000
#: template grams that may be sent to every task: some 20 MB
BROADCAST_GRAMS = 200_000


def template_grams(phrases=PHRASES, notices=NOTICES) -> list[tuple[bytes, int, int, str, bool, int, int]]:
    """(gram, template, place, label, phrase, k, words) for every place of every template; a template shorter than GRAM words is one gram."""
    out = []
    for number, (text, label) in enumerate([*phrases, *notices]):
        words = text.encode().translate(FOLD).split()
        if not words:
            raise ValueError("a template has words")
        k = min(GRAM, len(words))
        out += [(b" ".join(words[p : p + k]), number, p, label, number < len(phrases), k, len(words)) for p in range(len(words) - k + 1)]
    return out


def rolling_grams(docs: DataFrame, sizes: list[int], text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, digest, n_words, k, at, gram): every k-gram of each text for k in `sizes`, and one row with k = 0 and a null gram for the text itself, be it empty.
    digest is the MD5 of the text: with the id it tells texts apart, and rows that are equal in both are copies."""
    schema = "doc_id long, digest binary, n_words long, k int, first long, grams array<binary>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "digest", "n_words", "k", "first", "grams"]
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64()]
        for batch in batches:
            rows, flat, offsets = [], [], [0]

            def block() -> pa.RecordBatch:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.binary())))
                made = pa.RecordBatch.from_arrays(columns, names)
                rows.clear(), flat.clear()
                offsets[:] = [0]
                return made

            for i, text in zip(batch.column(0), batch.column(1), strict=True):
                i, text = i.as_py(), text.as_py()
                words, digest = text.translate(FOLD).split(), hashlib.md5(text).digest()
                n = len(words)
                flat.append(None)
                rows.append((i, digest, n, 0, 0))
                offsets.append(len(flat))
                grown, size = words, 1
                for k in sizes:
                    while size < k:
                        grown = [a + b" " + b for a, b in zip(grown, words[size:], strict=False)]
                        size += 1
                    for lo in range(0, n - k + 1, PIECE):
                        flat += grown[lo : lo + PIECE]
                        rows.append((i, digest, n, k, lo))
                        offsets.append(len(flat))
                if len(flat) >= 2 * PIECE:
                    yield block()
            if rows:
                yield block()
        give_back()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    laid = rows.mapInArrow(run, schema).select("doc_id", "digest", "n_words", "k", "first", F.posexplode("grams").alias("p", "gram"))
    return laid.select("doc_id", "digest", "n_words", "k", (F.col("first") + F.col("p")).alias("at"), "gram")


def diagonals(docs: DataFrame, templates: list[tuple], text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, digest, n_words, template, label, phrase, k, words, diagonal, places, copies): the places of a template that a text holds on one diagonal; for
    every text also a row with a null template, whose `copies` says how many rows of the table are that text under that id."""
    spark = docs.sparkSession
    known = spark.createDataFrame(templates, "word_gram binary, template int, place int, label string, phrase boolean, size int, words int")
    known = known.withColumn("hash", F.xxhash64("word_gram"))
    sizes = sorted({t[5] for t in templates})
    grams = rolling_grams(docs, sizes, text_col, id_col).withColumn("gram_hash", F.xxhash64("gram"))
    met = grams.join(F.broadcast(known) if len(templates) <= BROADCAST_GRAMS else known, (F.col("gram_hash") == F.col("hash")) & (F.col("gram") == F.col("word_gram")), "left")
    voted = met.where("k = 0 or template is not null").withColumn("diagonal", F.col("at") - F.col("place"))
    keys = ["doc_id", "digest", "n_words", "template", "label", "phrase", F.col("size").alias("k"), "words", "diagonal"]
    return voted.groupBy(*keys).agg(F.sort_array(F.collect_set("place")).alias("places"), F.count(F.when(F.col("k") == 0, 1)).alias("copies"))


def spans(voted: DataFrame) -> DataFrame:
    """Diagonals of a template at most SLIP apart put together: (doc_id, digest, n_words, template, label, phrase, words, start, end, cover, copies) with the words from
    start to before end, cover the share of the template's words that the votes prove. Each diagonal of a phrase, and the row of a text, stays alone."""
    w = Window.partitionBy("doc_id", "digest", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(w) <= SLIP
    numbered = voted.withColumn("_new", F.when(apart & ~F.col("phrase"), 0).otherwise(1)).withColumn("_span", F.sum("_new").over(w))
    first, last = F.col("diagonal") + F.col("places")[0], F.col("diagonal") + F.element_at("places", -1) + F.col("k")
    whole = numbered.groupBy("doc_id", "digest", "n_words", "template", "label", "phrase", "k", "words", "_span").agg(
        F.min(first).alias("start"), F.max(last).alias("end"), F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.max("copies").alias("copies")
    )
    proven = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + F.col("k") - 1))))
    return whole.withColumn("cover", F.size(proven) / F.col("words")).drop("_span", "k", "places")


def scan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """The spans of `spans` that hold: those of a phrase when all its words stand there, those of a notice when LEAST_COVER of its words do, in a stretch of
    the text at most 1 / LEAST_COVER times as long. A row with a null template stands for each text and says how often the table has it.

    Words are runs of digits, letters a to z (A-Z lower-cased) and characters beyond ASCII. Null texts are empty; null ids and repeated rows are kept; further
    columns are ignored, whatever their names; no rows give no rows."""
    found = spans(diagonals(docs, template_grams(phrases, notices), text_col, id_col))
    whole = F.col("phrase") & (F.col("cover") == 1)
    near = ~F.col("phrase") & (F.col("cover") >= LEAST_COVER) & ((F.col("end") - F.col("start")) * LEAST_COVER <= F.col("words"))
    return found.where(F.col("template").isNull() | whole | near)


def license_labels(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), one row per row of docs(doc_id, text): all places of phrases, the smallest and the largest
    of them, the labels of phrases and of phrases and notices, and the best cover of anything found (a phrase is 1, nothing 0)."""
    base = F.col("phrase") & F.col("template").isNotNull()
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    told = scan(docs).groupBy("doc_id", "digest", "n_words").agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"), F.max(F.when(base, F.col("start"))).alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"), joined(F.col("label")).alias("labels"), F.coalesce(F.max("cover"), F.lit(0.0)).alias("score"), F.max("copies").alias("copies"),
    )
    each = told.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return each.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def license_sql() -> str:
    """The same in SQL: words and grams as rows, templates as values."""
    values = ", ".join(f"('{g.decode()}', {t}, {p}, '{label}', {phrase}, {k}, {n})" for g, t, p, label, phrase, k, n in template_grams())
    return f"""
with tm(gram, template, place, label, phrase, k, words) as (values {values}),
d as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
n as (select rid, doc_id, len(w)::bigint as n_words from d),
p as (select rid, unnest(w) as word, unnest(range(len(w))) as pos from d),
g as (select rid, pos, string_agg(word, ' ') over (partition by rid order by pos rows between current row and 1 following) as g2,
        string_agg(word, ' ') over (partition by rid order by pos rows between current row and 3 following) as g4 from p),
hit as (select rid, template, label, phrase, tm.k, words, pos - place as diagonal, place from g join tm on tm.gram = g2 where tm.k = 2
        union all select rid, template, label, phrase, tm.k, words, pos - place, place from g join tm on tm.gram = g4 where tm.k = 4),
dg as (select rid, template, label, phrase, k, words, diagonal, list(distinct place) as places, min(place) as low, max(place) as high from hit group by all),
nw as (select *, case when not phrase and diagonal - lag(diagonal) over w <= {SLIP} then 0 else 1 end as new from dg window w as (partition by rid, template order by diagonal)),
sp as (select *, sum(new) over (partition by rid, template order by diagonal) as span from nw),
cv as (select rid, template, label, phrase, words, span, min(diagonal + low) as start, max(diagonal + high + k) as stop,
        len(list_distinct(flatten(list_transform(flatten(list(places)), lambda x: range(x, x + any_value(k)))))) / words as cover
       from sp group by rid, template, label, phrase, words, span),
ok as (select * from cv where case when phrase then cover = 1 else cover >= {LEAST_COVER} and (stop - start) * {LEAST_COVER} <= words end)
select n.doc_id, n_words, count(*) filter (phrase) as n_base, min(start) filter (phrase) as first_word, max(start) filter (phrase) as last_word,
  coalesce(string_agg(distinct label, ',' order by label) filter (phrase), '') as base_labels, coalesce(string_agg(distinct label, ',' order by label), '') as labels,
  coalesce(max(cover), 0) as score
from n left join ok using (rid) group by n.rid, n.doc_id, n_words
"""
