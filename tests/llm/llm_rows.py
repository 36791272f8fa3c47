"""Rows with nulls, empty and long texts, ties, repeated rows and ids."""
from pyspark.sql import types as T

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                    T.StructField("n_chars", T.LongType())])

EN = "the cat and the dog are in the house with the other animals of this town "
FR = "le chat et le chien sont dans la maison avec les autres animaux de cette ville "
# nulls in any column, empty and long texts, ties, repeated rows and ids
ROWS = [
    (1, "A b c.\nshared line\nOne two three four five", "en", "s1", 5),
    (2, "a  b C.\nshared line\nsix seven", "en", "s1", None),
    (3, "a  b C.\nshared line\nsix seven", None, "s1", 9),
    (4, None, "en", "s2", 0), (5, "", "en", None, 0), (6, " \n\t ", "fr", None, 3),
    (7, EN * 40, "en", "s1", 1), (8, EN * 40 + "x", "en", "s1", 1), (9, FR * 30, "fr", "s2", 1),
    (10, "shared line", "en", "s1", 1), (11, "shared line\n" * 3, "en", "s1", 1),
    (12, "w" * 5000 + " " + "é " * 3000, "fr", "s3", 1), (13, "12 34 !!", "en", "s3", 1),
    (None, "no id here at all", "en", "s3", 1), (None, "no id here at all", "en", "s3", 1),
    (14, "twice", "en", "s3", 1), (14, "twice", "en", "s3", 1), (14, "other text", "en", "s3", 1),
]
