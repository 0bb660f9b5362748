"""License scans: a positional index of rare licence words, intersected by relative position, with mandatory key phrases.

Only DataFrame functions. One pass over the texts keeps, per document, the places of the licence words and of the key phrases. From
these the document frequencies of the licence words are counted over all documents. The index holds each template's words of highest
IDF, as many as weigh more than what a match may lack, so that every match holds one of them. A file looks up those that it has and
gets candidates (template and relative position); those whose mandatory key phrase stands there are verified: all of the file's
licence words of equal template and relative position are added up by IDF, and AGREE of the template's weight has to agree.

Null or empty text: no words, no places, empty label lists, score 0. Null ids and repeated rows: each row is scanned by itself.
No rows: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from worklake.llm.common import kept, query, table

NO_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
AGREE = 0.6  # least share of a template's weight

# Phrases and their labels as the contract gives them.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Notices of public licences in their own words, as (label, notice, mandatory key phrase).
TEMPLATES = (
    ("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-notice", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the "
                   "free software foundation", "under the terms of the gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation",
     "gnu lesser general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("mit-notice", "released under the mit license", "mit license"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
                 "documentation files", "permission is hereby granted free of charge"),
    ("isc-text", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     "with or without fee is hereby granted"),
    ("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
                 "following conditions are met", "redistribution and use in source and binary forms"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc0", "cc0 1 0 universal public domain dedication", "public domain dedication"),
)
# Words too common to be looked up.
STOP = frozenset("a and any are as by can for free in is it met of on or that the this to under use with you your 0 1 2 3 4".split())

INDEX = sorted({w for _, notice, _ in TEMPLATES for w in notice.split()} - STOP)
POSTINGS = [(w, t, i) for t, (_, notice, _) in enumerate(TEMPLATES) for i, w in enumerate(notice.split()) if w not in STOP]
PHRASES = [(label, phrase, -1, 0) for phrase, label in BASE.items()]  # label, phrase, template, place in the template's notice
PHRASES += [(label, key, t, len(notice[:notice.index(key)].split())) for t, (label, notice, key) in enumerate(TEMPLATES)]


def _places(phrase: str) -> Column:
    """Starts of a phrase: from the places of its rarest-looking word, the words around are compared."""
    parts = phrase.split()
    at = next(i for i, w in enumerate(parts) if w not in STOP)

    def stands(h: Column) -> Column:
        fits = h["word"] == parts[at]
        for i, w in enumerate(parts):
            if i != at:
                fits = fits & (F.get("words", h["pos"] - at + i) == w)
        return fits
    return F.transform(F.filter("hits", stands), lambda h: h["pos"] - at)


def _numbered(number: int, phrase: str) -> Column:
    return F.transform(_places(phrase), lambda x: F.struct(F.lit(number).alias("number"), x.alias("pos")))


def scanned(docs: DataFrame) -> DataFrame:
    """rid, doc_id, n_words, hits (word, pos), phrases (number, pos): the only pass over the texts. rid is a number of the row."""
    # ASCII letters fold as the contract asks; other letters fold too, which no phrase here can see.
    words = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), NO_WORD, " "), " "), lambda w: w != "")
    t = docs.select("doc_id", words.alias("words"))
    t = t.withColumn("found", F.array_intersect("words", F.array(*map(F.lit, INDEX))))
    places = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("pos"))), lambda h: F.array_contains("found", h["word"]))
    none = F.array().cast("array<struct<word:string,pos:int>>")
    t = t.withColumn("hits", F.when(F.size("found") > 0, places).otherwise(none))
    each = [_numbered(k, p[1]) for k, p in enumerate(PHRASES)]
    phrases = F.when(F.size("hits") > 0, F.concat(*each)).otherwise(F.array().cast("array<struct<number:int,pos:int>>"))
    return t.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.size("words").cast("long").alias("n_words"), "hits", phrases.alias("phrases"))


def rarest(weighed: DataFrame) -> DataFrame:
    """word, template, tpos of the words of highest IDF of each template that weigh more than 1 - AGREE of it together."""
    order = Window.partitionBy("template").orderBy(F.desc("idf"), "word", "tpos")
    before = F.coalesce(F.sum("idf").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return weighed.withColumn("before", before).where(F.col("before") <= (1 - AGREE + 1e-9) * F.col("weight")).select("word", "template", "tpos")


def template_matches(scan: DataFrame) -> DataFrame:
    """rid, found (labels), score of the files in which a template's words and key phrase stand at one relative position."""
    spark = scan.sparkSession
    hits = scan.select("rid", F.explode("hits").alias("h")).select("rid", "h.word", "h.pos")
    of_file = hits.select("rid", "word").distinct()
    counts = of_file.groupBy("word").count()  # a row for each word of INDEX at most, as all that is broadcast here
    idf = counts.crossJoin(scan.agg(F.count(F.lit(1)).alias("n"))).select("word", F.log((F.col("n") + 1) / (F.col("count") + 0.5)).alias("idf"))
    idf = idf.withColumn("idf", F.greatest(F.lit(0.01), "idf"))
    postings = spark.createDataFrame(POSTINGS, "word string, template int, tpos int")
    weighed = kept(postings.join(F.broadcast(idf), "word"), "license-index")  # POSTINGS at most
    weights = weighed.groupBy("template").agg(F.sum("idf").alias("weight"))
    number = spark.createDataFrame([(k, t, off, label) for k, (label, _, t, off) in enumerate(PHRASES) if t >= 0], "number int, template int, off int, label string")
    keys = scan.select("rid", F.explode("phrases").alias("p")).select("rid", "p.number", "p.pos").join(F.broadcast(number), "number")
    keys = keys.select("rid", "template", (F.col("pos") - F.col("off")).alias("origin"), "label").distinct()
    looked_up = hits.join(F.broadcast(rarest(weighed.join(weights, "template"))), "word")
    candidates = looked_up.select("rid", "template", (F.col("pos") - F.col("tpos")).alias("origin")).distinct()
    keys = keys.join(candidates, ["rid", "template", "origin"])
    # All hits of a file with a candidate: what agrees at a place doesn't depend on what else the file holds.
    agreed = (hits.join(keys.select("rid").distinct(), "rid", "left_semi").join(F.broadcast(weighed), "word")
              .groupBy("rid", "template", (F.col("pos") - F.col("tpos")).alias("origin")).agg(F.sum("idf").alias("agreed")))
    fits = agreed.join(keys, ["rid", "template", "origin"]).join(F.broadcast(weights), "template")
    fits = fits.withColumn("share", F.least(F.lit(1.0), F.col("agreed") / F.col("weight"))).where(F.col("share") >= AGREE)
    return fits.groupBy("rid").agg(F.collect_set("label").alias("found"), F.max("share").alias("share"))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document."""
    scan = kept(scanned(docs), "license-scan")
    matches = template_matches(scan)
    base = F.filter("phrases", lambda p: p["number"] < len(BASE))
    names = F.array(*(F.lit(p[0]) for p in PHRASES[:len(BASE)]))
    scan = scan.select("rid", "doc_id", "n_words", F.transform(base, lambda p: p["pos"].cast("long")).alias("starts"),
                       F.array_sort(F.array_distinct(F.transform(base, lambda p: F.get(names, p["number"])))).alias("base_labels"))
    joined = scan.join(matches, "rid", "left")
    every = F.array_sort(F.array_union("base_labels", F.coalesce("found", F.array().cast("array<string>"))))
    return joined.select("doc_id", "n_words", F.size("starts").cast("long").alias("n_base"), F.array_min("starts").alias("first_word"),
                         F.array_max("starts").alias("last_word"), F.array_join("base_labels", ",").alias("base_labels"),
                         F.array_join(every, ",").alias("labels"),
                         F.when(F.size("starts") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"))


@query("op5_license_scan")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
