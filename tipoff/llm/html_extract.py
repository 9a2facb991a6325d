"""Main text of HTML pages from flat text blocks.

A page is cut into blocks at block-level tags. Of each block the word count and link density, those of its
neighbours, and where it stands (inside the article, inside a navigation part or one named as advert, comments and so
on) go through a decision tree, which says whether it belongs to the article. The tree is trained by
Spark ML on the labelled blocks below and turned into a column expression, so pages are cut up in Arrow batches
and blocks are classified in the JVM, within the row: no shuffle.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tipoff.llm.common import texts

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "article", "boxed")

# Labelled blocks. article: 1 inside the page's article, 0 if the page has none, -1 outside it.
# boxed: 1 inside a navigation, header, footer, aside or form element, or inside one whose class, id or role names
# a menu, sidebar, notice, advert or comments.
# Outside the article a long block of few links is wanted next to another one, a short one between two. On a page without article a
# long one is wanted anywhere, a short one next to a long one. Inside, links in a row and labels between links are not wanted.
# words links words_before links_before words_after links_after article boxed  wanted
LABELLED = """
    9 0.00    0 0.00   80 0.00   1 0  1
   80 0.00    9 0.00   60 0.05   1 0  1
    1 0.00   80 0.00   45 0.00   1 0  1
   45 0.10    1 0.00    2 0.00   1 0  1
    2 0.00   45 0.10  120 0.02   1 0  1
  120 0.02    2 0.00    3 1.00   1 0  1
   25 0.40   60 0.00   30 0.00   1 0  1
    4 0.00    5 1.00   70 0.00   1 0  1
   12 0.00    3 1.00    1 0.00   1 0  1
    1 0.00   12 0.00    6 0.00   1 0  1
    6 0.00    1 0.00    7 0.50   1 0  1
    3 1.00   40 0.00   50 0.00   1 0  1
   50 0.00    3 1.00    0 0.00   1 0  1
    1 0.00    1 1.00   11 0.00   1 0  1
   11 0.00    1 0.00    8 0.10   1 0  1
    1 0.00   30 0.00    0 0.00   1 0  1
    2 0.00    1 0.00    1 1.00   1 0  1
    4 0.00   25 0.00    2 0.00   1 0  1
    5 0.00    3 0.00    3 0.00   1 0  1
   12 1.00   60 0.00   20 0.00   1 0  1
    8 0.80   20 0.00    1 0.00   1 0  1
   30 0.90    1 0.00    0 0.00   1 0  1
    2 1.00    3 1.00    2 1.00   1 0  0
    7 0.60   12 1.00   60 0.00   1 0  0
    1 0.00    0 0.00    0 0.00   1 0  1
    1 0.00    3 1.00   12 0.00   1 0  1
    1 0.00   22 0.00   45 0.60   1 0  1
    1 0.00   28 0.00   28 0.00   1 0  1
    1 0.00   60 0.20    0 0.00   1 0  1
    1 0.80    0 0.00   45 0.80   1 0  0
    1 0.90   30 0.90    0 0.00   1 0  0
    1 1.00    1 0.00    0 0.00   1 0  1
    2 0.00    0 0.00   45 0.20   1 0  1
    2 0.00    3 0.00    6 0.90   1 0  1
    2 0.00   16 0.00    0 0.00   1 0  1
    2 0.00   22 0.80   80 0.02   1 0  1
    2 0.90    3 1.00   35 0.00   1 0  0
    2 1.00    1 0.80    8 0.00   1 0  0
    2 1.00    2 0.80    0 0.00   1 0  0
    2 1.00   12 0.00   22 0.90   1 0  0
    3 0.00   12 0.00   70 0.60   1 0  1
    3 0.00   16 0.00  110 0.00   1 0  1
    3 0.80    3 0.00   35 0.10   1 0  1
    3 0.90    0 0.00    3 0.80   1 0  0
    3 1.00    0 0.00    0 0.00   1 0  1
    3 1.00    1 0.80   30 0.60   1 0  0
    3 1.00    3 0.00    1 0.90   1 0  0
    4 0.90   80 0.02   28 0.00   1 0  1
    4 1.00    2 0.00    2 0.00   1 0  1
    4 1.00   80 0.05   16 0.00   1 0  1
    5 0.00    0 0.00    1 0.00   1 0  1
    5 0.00    0 0.00    6 0.80   1 0  1
    5 0.00    0 0.00   22 0.60   1 0  1
    5 0.00    1 0.00    1 0.00   1 0  1
    5 0.00    1 0.90   22 0.02   1 0  1
    5 0.00   30 0.60    9 0.80   1 0  0
    5 0.00   45 0.80   16 0.00   1 0  1
    5 0.00   45 0.90    0 0.00   1 0  1
    6 0.80   22 0.60    1 0.00   1 0  0
    8 0.00    1 0.80   45 0.80   1 0  1
    8 0.00    3 0.80    3 0.80   1 0  1
    8 0.00   80 0.02    1 0.00   1 0  1
    9 1.00   22 0.80   45 0.10   1 0  0
   12 0.00    6 1.00    0 0.00   1 0  1
   12 0.00   45 0.20    3 0.80   1 0  1
   16 0.00   30 0.90   30 0.80   1 0  1
   22 0.00    0 0.00   70 0.80   1 0  1
   22 0.00   28 0.00    0 0.00   1 0  1
   22 0.02    9 0.80   22 0.60   1 0  1
   22 0.05    0 0.00    2 0.90   1 0  1
   22 0.20    2 0.00    2 1.00   1 0  1
   22 0.60    0 0.00    6 0.90   1 0  0
   22 0.60   30 0.90  110 0.00   1 0  0
   22 0.80    3 1.00   60 0.10   1 0  0
   22 0.80   60 0.00    5 0.00   1 0  1
   22 0.90   28 0.10   70 0.60   1 0  0
   22 0.90   45 0.60    5 0.00   1 0  0
   28 0.02    0 0.00   45 0.10   1 0  1
   30 0.60    4 1.00    0 0.00   1 0  0
   30 0.90    2 0.90    8 0.00   1 0  0
   35 0.00   12 0.00   45 0.90   1 0  1
   35 0.00   45 0.02   80 0.02   1 0  1
   35 0.00   70 0.90    0 0.00   1 0  1
   35 0.05    6 1.00   45 0.00   1 0  1
   35 0.10    0 0.00    0 0.00   1 0  1
   35 0.10    2 0.90    6 1.00   1 0  1
   35 0.20  110 0.20    1 0.00   1 0  1
   45 0.10  110 0.20    4 0.90   1 0  1
   45 0.20   60 0.20   70 0.80   1 0  1
   45 0.80    0 0.00    8 0.00   1 0  1
   45 0.80    2 0.00    6 1.00   1 0  0
   60 0.00    0 0.00    5 0.00   1 0  1
   60 0.00    1 0.80    5 0.00   1 0  1
   70 0.60    3 0.00    0 0.00   1 0  1
   70 0.60   22 0.02   28 0.02   1 0  1
   70 0.80    0 0.00   60 0.00   1 0  1
   70 0.90    0 0.00   70 0.60   1 0  0
   80 0.00   16 0.00   80 0.10   1 0  1
   80 0.02   45 0.60   45 0.00   1 0  1
   80 0.02   45 0.90    5 0.00   1 0  1
   80 0.10    4 1.00    0 0.00   1 0  1
   80 0.20    1 0.00    0 0.00   1 0  1
  110 0.00   22 0.60    4 1.00   1 0  1
  110 0.00   30 0.80   30 0.80   1 0  1
  110 0.02    1 0.00    8 0.00   1 0  1
   25 0.00   45 0.00   60 0.00   1 1  0
    4 1.00   45 0.00   60 0.00   1 1  0
    2 0.00   33 0.00   80 0.00   1 1  0
   18 0.00   70 0.00   55 0.00   1 1  0
    3 0.00   70 0.00   55 0.00   1 1  0
   60 0.00   90 0.00   20 0.00   1 1  0
   20 0.00   60 0.00    2 1.00   1 1  0
    1 0.00    2 0.80    2 0.00   1 1  0
    1 0.00   80 0.10   45 0.00   1 1  0
    2 0.00   22 0.00    2 0.00   1 1  0
    3 0.00    9 1.00   22 0.05   1 1  0
    8 0.00   12 0.00    5 0.00   1 1  0
   12 0.00    1 0.00   35 0.10   1 1  0
   12 0.00   16 0.00    6 0.80   1 1  0
   12 0.00   22 0.00    3 0.80   1 1  0
   16 0.00    9 1.00    2 0.80   1 1  0
   22 0.00   60 0.00    4 1.00   1 1  0
   22 0.05    8 0.00   12 0.00   1 1  0
   28 0.00    1 0.00  110 0.00   1 1  0
   28 0.00    5 0.00    2 0.90   1 1  0
   60 0.00    4 0.90    9 0.90   1 1  0
   60 0.10   60 0.02   60 0.05   1 1  0
   80 0.00    9 0.90   12 0.00   1 1  0
   80 0.02   28 0.00    1 0.00   1 1  0
  110 0.05    2 0.80   22 0.00   1 1  0
    9 0.00    2 0.00   66 0.00   0 0  1
   66 0.00    9 0.00   48 0.08   0 0  1
   48 0.08   66 0.00    4 0.00   0 0  1
    4 0.00   48 0.08   90 0.00   0 0  1
   90 0.00    4 0.00    3 1.00   0 0  1
   22 0.10   30 0.00   28 0.00   0 0  1
   16 0.00    5 0.00   40 0.00   0 0  1
   35 0.20    1 1.00    2 1.00   0 0  1
    3 0.00   75 0.00   40 0.00   0 0  1
    1 0.00   40 0.00   52 0.00   0 0  1
    1 1.00    0 0.00    1 1.00   0 0  0
    2 1.00    1 1.00    2 1.00   0 0  0
    3 1.00    2 1.00    9 0.00   0 0  0
    4 0.75    3 1.00    5 0.80   0 0  0
   18 0.90    5 1.00    4 1.00   0 0  0
   30 0.80   90 0.00    3 1.00   0 0  0
    3 0.00    2 1.00    2 1.00   0 0  0
    5 0.00    1 1.00    3 0.00   0 0  0
    4 0.20    6 0.00    0 0.00   0 0  0
   20 0.00   30 0.00   25 0.00   0 0  1
   33 0.05   20 0.00   27 0.10   0 0  1
   15 0.00   60 0.00    0 0.00   0 0  1
   40 0.00    0 0.00   30 0.00   0 0  1
   30 0.00   40 0.00    2 1.00   0 0  1
   28 0.00    0 0.00    0 0.00   0 0  1
   10 0.00    0 0.00   45 0.00   0 0  1
  110 0.03   60 0.00   85 0.00   0 0  1
   70 0.00  110 0.03    1 1.00   0 0  1
    6 0.00   35 0.00   31 0.00   0 0  1
    2 1.00   90 0.00    2 1.00   0 0  0
    6 1.00   20 0.00    4 1.00   0 0  0
   12 0.95   15 0.00   30 0.00   0 0  0
    1 1.00   40 0.00    1 1.00   0 0  0
    2 0.00    2 1.00    4 0.00   0 0  0
    3 0.00    0 0.00    1 1.00   0 0  0
   60 0.00    1 1.00   40 0.00   0 0  1
   25 0.00    2 1.00   30 0.00   0 0  1
   80 0.02    3 1.00    1 0.00   0 0  1
   50 0.10   12 0.50   40 0.00   0 0  1
   30 0.25   50 0.00   40 0.00   0 0  1
   45 0.20   60 0.00   50 0.10   0 0  1
   90 0.05    6 0.80    5 1.00   0 0  1
   35 0.00    4 1.00    3 1.00   0 0  1
    4 0.30   20 0.00    2 1.00   0 0  0
    8 0.00    3 1.00    2 1.00   0 0  0
    1 0.00    0 0.00    6 1.00   0 0  0
    1 0.00    3 0.00    3 1.00   0 0  0
    1 0.00   35 0.00    3 0.00   0 0  1
    1 0.00   70 0.80   22 0.80   0 0  0
    1 0.90    1 0.00   35 0.02   0 0  0
    2 0.00    0 0.00   45 0.80   0 0  0
    2 0.00    5 0.00    8 0.00   0 0  0
    2 0.00    9 0.80    0 0.00   0 0  0
    2 0.00   22 0.00   70 0.60   0 0  1
    2 1.00    8 0.00    1 1.00   0 0  0
    3 0.00    9 0.90   28 0.00   0 0  1
    3 0.00   22 0.02   28 0.00   0 0  1
    3 0.90   22 0.60    9 1.00   0 0  0
    3 1.00    8 0.00    0 0.00   0 0  0
    3 1.00   70 0.80    0 0.00   0 0  0
    4 0.80    0 0.00    1 0.80   0 0  0
    4 0.80   22 0.80    1 0.00   0 0  0
    4 0.90    1 1.00    0 0.00   0 0  0
    4 0.90   70 0.80   80 0.00   0 0  0
    5 0.00    0 0.00   12 0.00   0 0  0
    5 0.00    0 0.00   45 0.20   0 0  1
    5 0.00   70 0.90   22 0.10   0 0  1
    6 0.90    3 0.00    5 0.00   0 0  0
    6 1.00   22 0.02   22 0.02   0 0  0
    8 0.00    9 0.90    9 1.00   0 0  0
    8 0.00   16 0.00   30 0.90   0 0  0
    8 0.00   30 0.80    3 0.00   0 0  0
    8 0.00   35 0.00    1 0.80   0 0  1
    8 0.00   80 0.00    0 0.00   0 0  1
    9 0.80    0 0.00   30 0.60   0 0  0
    9 0.80   45 0.02    4 1.00   0 0  0
    9 1.00   80 0.00   12 0.00   0 0  0
   12 0.00    0 0.00    0 0.00   0 0  0
   12 0.00    2 1.00   16 0.00   0 0  0
   16 0.00    1 0.00   22 0.00   0 0  1
   16 0.00    6 1.00   30 0.60   0 0  0
   16 0.00    8 0.00    0 0.00   0 0  0
   16 0.00   22 0.90    6 1.00   0 0  0
   16 0.00   30 0.60    0 0.00   0 0  0
   22 0.00    0 0.00   70 0.90   0 0  1
   22 0.00    1 1.00  110 0.00   0 0  1
   22 0.00    6 0.90    3 1.00   0 0  1
   22 0.02   45 0.00   80 0.20   0 0  1
   22 0.10    0 0.00    9 0.80   0 0  1
   22 0.60   45 0.90    1 0.80   0 0  0
   28 0.00   45 0.60    0 0.00   0 0  1
   28 0.05   70 0.60    4 1.00   0 0  1
   30 0.60    4 0.90   35 0.00   0 0  0
   30 0.80   45 0.80    0 0.00   0 0  0
   35 0.00    0 0.00   16 0.00   0 0  1
   35 0.00   22 0.10    3 1.00   0 0  1
   35 0.00   22 0.60   12 0.00   0 0  1
   35 0.05    0 0.00    0 0.00   0 0  1
   35 0.05   22 0.00    0 0.00   0 0  1
   35 0.10    3 1.00    0 0.00   0 0  1
   45 0.02   80 0.00   70 0.80   0 0  1
   45 0.20   12 0.00    3 0.90   0 0  1
   45 0.60    0 0.00   12 0.00   0 0  0
   45 0.60  110 0.00  110 0.02   0 0  0
   45 0.80    9 1.00    3 0.00   0 0  0
   45 0.80   70 0.60    8 0.00   0 0  0
   45 0.90   30 0.60   70 0.80   0 0  0
   60 0.05    5 0.00   45 0.60   0 0  1
   60 0.10   30 0.80   35 0.20   0 0  1
   70 0.60    2 1.00    1 1.00   0 0  0
   70 0.80    8 0.00   30 0.90   0 0  0
   80 0.00    1 1.00   45 0.60   0 0  1
   80 0.02   60 0.02    3 0.00   0 0  1
   80 0.02   70 0.90   70 0.90   0 0  1
   80 0.10    0 0.00   80 0.00   0 0  1
  110 0.00    1 0.00   22 0.00   0 0  1
  110 0.00    1 0.80   16 0.00   0 0  1
  110 0.00    3 0.00   16 0.00   0 0  1
  110 0.10    2 0.00    0 0.00   0 0  1
   40 0.00   70 0.00    0 0.00   0 1  0
    2 1.00    0 0.00   66 0.00   0 1  0
   70 0.00   40 0.00   50 0.00   0 1  0
   28 0.00   60 0.00   35 0.00   0 1  0
    7 0.00   28 0.00   60 0.00   0 1  0
   80 0.00   60 0.00   35 0.00   0 1  0
    2 0.00    2 0.00    1 0.00   0 1  0
    3 0.00    8 0.00  110 0.02   0 1  0
    3 0.00   60 0.00    5 0.00   0 1  0
    5 0.00    1 1.00   80 0.00   0 1  0
    8 0.00   35 0.00   22 0.05   0 1  0
    8 0.00   35 0.05    2 1.00   0 1  0
   16 0.00    2 0.00    9 1.00   0 1  0
   16 0.00    3 1.00    1 0.80   0 1  0
   16 0.00    9 0.80    5 0.00   0 1  0
   22 0.02   28 0.00    6 1.00   0 1  0
   28 0.00    3 0.90   45 0.05   0 1  0
   35 0.00    2 0.90    2 0.00   0 1  0
   35 0.10    1 0.00    9 1.00   0 1  0
   35 0.20    8 0.00   35 0.00   0 1  0
   60 0.00   35 0.00   16 0.00   0 1  0
   60 0.10    1 1.00    1 1.00   0 1  0
   80 0.20    8 0.00   12 0.00   0 1  0
   80 0.20   35 0.00   45 0.00   0 1  0
   30 0.00   14 0.00    5 0.20  -1 0  0
    5 0.20   30 0.00    0 0.00  -1 0  0
    3 0.00    4 1.00   11 0.00  -1 0  0
   55 0.00    7 0.00    9 0.10  -1 0  0
    2 1.00   80 0.00    2 1.00  -1 0  0
    1 0.00    0 0.00    3 0.90  -1 0  0
    1 0.00    2 0.00   70 0.60  -1 0  0
    1 0.00    5 0.00    9 0.90  -1 0  0
    1 0.00    9 0.80    0 0.00  -1 0  0
    1 0.00   45 0.02   80 0.00  -1 0  1
    1 0.00   45 0.90    1 0.80  -1 0  0
    2 0.00   22 0.02   16 0.00  -1 0  0
    2 0.00   28 0.00   28 0.00  -1 0  1
    2 0.00   45 0.60   45 0.90  -1 0  0
    2 0.90   16 0.00   12 0.00  -1 0  0
    2 1.00    0 0.00    0 0.00  -1 0  0
    2 1.00    2 0.00    0 0.00  -1 0  0
    2 1.00   22 0.80   28 0.00  -1 0  0
    2 1.00   28 0.02    2 0.80  -1 0  0
    3 0.00    6 0.80    4 1.00  -1 0  0
    3 0.00   35 0.00    2 0.90  -1 0  0
    5 0.00    0 0.00    3 0.00  -1 0  0
    5 0.00    4 0.90   70 0.80  -1 0  0
    5 0.00   16 0.00  110 0.20  -1 0  0
    5 0.00   30 0.90   22 0.00  -1 0  0
    6 0.90   30 0.60   45 0.80  -1 0  0
    6 1.00    1 1.00   22 0.90  -1 0  0
    6 1.00   45 0.10   45 0.90  -1 0  0
    8 0.00    1 0.00    0 0.00  -1 0  0
    8 0.00    2 1.00   35 0.05  -1 0  0
    8 0.00    5 0.00    5 0.00  -1 0  0
    8 0.00   45 0.60   12 0.00  -1 0  0
    8 0.00   60 0.00   30 0.90  -1 0  0
    8 0.00   80 0.10    0 0.00  -1 0  0
    9 0.90    5 0.00    4 1.00  -1 0  0
    9 1.00    6 0.90   12 0.00  -1 0  0
    9 1.00   45 0.20    0 0.00  -1 0  0
   12 0.00    0 0.00    0 0.00  -1 0  0
   12 0.00    0 0.00   45 0.80  -1 0  0
   12 0.00    0 0.00  110 0.00  -1 0  0
   16 0.00    2 0.90    2 0.00  -1 0  0
   16 0.00   30 0.60    0 0.00  -1 0  0
   16 0.00  110 0.00   45 0.05  -1 0  1
   22 0.00    0 0.00   80 0.10  -1 0  1
   22 0.00    2 0.80    3 0.90  -1 0  0
   22 0.00   22 0.05    0 0.00  -1 0  1
   22 0.00   70 0.90   12 0.00  -1 0  0
   22 0.02   22 0.60    0 0.00  -1 0  0
   22 0.02   60 0.20   22 0.80  -1 0  1
   22 0.05    1 0.00   30 0.80  -1 0  0
   22 0.05    3 1.00   45 0.00  -1 0  1
   22 0.20    9 0.80   45 0.00  -1 0  1
   22 0.20   16 0.00  110 0.10  -1 0  1
   22 0.20   60 0.20    3 0.00  -1 0  1
   22 0.60    0 0.00   80 0.00  -1 0  0
   22 0.60    2 0.00   45 0.60  -1 0  0
   22 0.80   12 0.00   60 0.05  -1 0  0
   28 0.00    1 1.00   22 0.05  -1 0  1
   28 0.00    6 0.80    8 0.00  -1 0  0
   28 0.00   22 0.00    0 0.00  -1 0  1
   28 0.00   30 0.80   35 0.00  -1 0  1
   28 0.00   30 0.90   22 0.00  -1 0  1
   28 0.02   35 0.05   28 0.02  -1 0  1
   28 0.02   80 0.00   22 0.20  -1 0  1
   28 0.05    6 1.00   45 0.90  -1 0  0
   28 0.10    0 0.00   28 0.02  -1 0  1
   28 0.20  110 0.05    9 1.00  -1 0  1
   30 0.80   60 0.10    0 0.00  -1 0  0
   30 0.90    3 0.90    0 0.00  -1 0  0
   35 0.00   22 0.10  110 0.00  -1 0  1
   35 0.02    2 0.00   60 0.00  -1 0  1
   35 0.05   22 0.05    2 0.00  -1 0  1
   35 0.05   70 0.90  110 0.02  -1 0  1
   35 0.10    0 0.00    0 0.00  -1 0  0
   35 0.10    4 0.80    6 1.00  -1 0  0
   35 0.20    0 0.00    0 0.00  -1 0  0
   35 0.20   28 0.02    0 0.00  -1 0  1
   35 0.20   60 0.05    5 0.00  -1 0  1
   45 0.00    0 0.00   22 0.00  -1 0  1
   45 0.00    0 0.00   45 0.10  -1 0  1
   45 0.00    3 1.00   70 0.80  -1 0  0
   45 0.00    3 1.00  110 0.00  -1 0  1
   45 0.02   22 0.00    1 0.90  -1 0  1
   45 0.05    0 0.00    3 1.00  -1 0  0
   45 0.10    0 0.00    0 0.00  -1 0  0
   45 0.10   22 0.05    0 0.00  -1 0  1
   45 0.10   45 0.60   70 0.80  -1 0  0
   45 0.20    3 0.00    0 0.00  -1 0  0
   45 0.60    0 0.00   45 0.60  -1 0  0
   45 0.90   30 0.80   30 0.80  -1 0  0
   60 0.00    6 1.00    3 1.00  -1 0  0
   60 0.00   12 0.00  110 0.20  -1 0  1
   60 0.00   28 0.10   22 0.90  -1 0  1
   60 0.00   45 0.60   22 0.00  -1 0  1
   60 0.02   45 0.20    6 1.00  -1 0  1
   60 0.05    1 0.00   60 0.00  -1 0  1
   60 0.05   30 0.80   30 0.80  -1 0  0
   60 0.10    2 0.00    3 1.00  -1 0  0
   60 0.20   12 0.00    2 0.00  -1 0  0
   70 0.80   22 0.90    0 0.00  -1 0  0
   80 0.00    6 0.80    0 0.00  -1 0  0
   80 0.00   70 0.60   22 0.90  -1 0  0
   80 0.00   80 0.00   80 0.00  -1 0  1
   80 0.10   45 0.90    6 0.90  -1 0  0
  110 0.00    4 1.00   45 0.80  -1 0  0
  110 0.00   45 0.10   30 0.90  -1 0  1
  110 0.00   60 0.10    1 0.90  -1 0  1
  110 0.02    0 0.00    1 0.00  -1 0  0
  110 0.05    0 0.00   45 0.90  -1 0  0
  110 0.10   80 0.10   16 0.00  -1 0  1
  110 0.20   80 0.02   22 0.60  -1 0  1
    1 1.00    0 0.00    1 1.00  -1 1  0
    1 1.00    1 1.00    1 1.00  -1 1  0
    2 1.00    1 1.00   12 0.00  -1 1  0
    8 0.10   50 0.00    0 0.00  -1 1  0
   40 0.00   60 0.00    0 0.00  -1 1  0
   12 0.00    2 1.00    9 0.00  -1 1  0
    6 0.00    1 1.00   70 0.00  -1 1  0
   35 0.05    1 1.00   14 0.00  -1 1  0
   14 0.00   90 0.00   30 0.00  -1 1  0
    2 0.00    5 0.00    2 0.00  -1 1  0
    3 0.00    3 0.00   22 0.00  -1 1  0
    3 0.00   60 0.02    2 0.00  -1 1  0
    5 0.00    2 0.80   22 0.20  -1 1  0
    5 0.00    6 1.00    3 0.90  -1 1  0
    8 0.00    1 0.80   16 0.00  -1 1  0
    8 0.00   35 0.05    6 1.00  -1 1  0
    8 0.00   35 0.20   45 0.00  -1 1  0
   12 0.00    3 0.00    9 0.80  -1 1  0
   22 0.10    3 0.00  110 0.10  -1 1  0
   35 0.00  110 0.02    8 0.00  -1 1  0
   45 0.00    2 1.00    1 0.00  -1 1  0
   45 0.00   22 0.00   35 0.02  -1 1  0
   60 0.00    1 0.00   16 0.00  -1 1  0
   60 0.02   12 0.00    2 1.00  -1 1  0
   60 0.10   22 0.00    9 1.00  -1 1  0
  110 0.00    6 0.80    2 0.80  -1 1  0
  110 0.00    6 1.00   28 0.00  -1 1  0
    2 0.00   60 0.00    0 0.00  -1 0  0
    1 0.00   45 0.00    5 0.00  -1 0  0
    2 0.00   80 0.00    3 1.00  -1 0  0
    1 0.00   90 0.00   12 0.00  -1 0  0
    2 0.00    1 1.00    1 1.00   1 0  0
    1 0.00    2 1.00    1 1.00   1 0  0
    3 0.00    1 1.00    4 1.00   1 0  0
    5 0.00    2 1.00    2 0.80   1 0  0
    4 0.00    3 0.90    1 1.00   1 0  0
    2 0.00    6 1.00    9 0.90   1 0  0
    6 0.00    1 1.00    2 1.00   1 0  0
"""

# element names: what cuts blocks, what is dropped with its content, what makes a navigation part
CUTTING = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frame "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noframes ol option optgroup p pre section select summary "
    "table tbody td tfoot th thead title tr ul video audio canvas caption".split()
)
DROPPED = ("script", "style", "noscript", "template", "svg", "math", "iframe", "object", "textarea", "select", "button", "title")
PARTS = frozenset("nav header footer aside form menu dialog".split())
ARTICLES = frozenset("article main".split())
HOLDING = frozenset("article aside blockquote details dialog div dl fieldset figure footer form header li main menu nav ol section table td tr ul".split())
# words in class, id, role or label that name such a part
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored sponsor promo promotion promoted outbrain taboola "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs toolbar topbar header masthead footer foot copyright "
    "sidebar sidenav aside widget widgets related recommended share sharing social "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login paywall disclaimer "
    "comment comments commentlist respond reply replies disqus discussion form search pagination pager complementary contentinfo "
    "hidden".split()
)
# words that make such a name a layout's, which an article may lie in, and those that no layout word excuses
LAYOUT = frozenset("wrapper wrap page site layout has with".split())
FOREIGN = frozenset("comment comments commentlist respond reply replies disqus discussion related recommended teaser teasers widget widgets promo sponsored".split())

_DROP = "|".join(DROPPED)
TAG = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<drop>{_DROP})\b(?:\"[^\"]*\"|'[^']*'|[^\"'>])*>.*?(?:</(?P=drop)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^\"'<>])*)(?:>|\Z|(?=<))|<[!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
NAMING = re.compile(r"(?:^|\s)(?:class|id|role|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
HIDING = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none", re.I)
WORD = re.compile(r"[a-z]+")


def _named(rest: str) -> int:
    """1 if an element's names make it such a part but for an article inside it, 2 if for that too, else 0."""
    if not rest.strip():
        return 0
    words = {w for m in NAMING.finditer(rest) for w in WORD.findall(m[1].lower())}
    if HIDING.search(rest) is not None:
        return 2
    if NAMES.isdisjoint(words):
        return 0
    return 2 if LAYOUT.isdisjoint(words) or not FOREIGN.isdisjoint(words) else 1


def blocks(page: str) -> list[tuple]:
    """Text blocks of a page in order: the text, then FEATURES.

    White space inside a block is one blank and blocks without text are left out. Markup may be cut off or badly nested: a closing tag
    closes the nearest open element of its name, if any. A wrapper named after its sidebar does not count against the page's
    first article or main element in it; one inside a boxed part is neither that nor the page's article.
    """
    found: list[list] = []  # text, words, links, in article, boxed
    pieces: list[str] = []
    linked = 0
    held: list[tuple[str, int, int]] = []  # open elements with what holds inside them: in article, boxed
    article = boxed = 0  # article: 1 inside a main element, 2 inside an article
    in_link, seen, at = False, set(), 0

    def cut():
        nonlocal linked
        text = " ".join(html.unescape("".join(pieces)).split())
        if text:
            words = len(text.split())
            found.append([text, words, min(linked / words, 1.0), article, int(boxed > 0)])
        pieces.clear()
        linked = 0

    for m in TAG.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            pieces.append(piece)
            if in_link:
                linked += len(html.unescape(piece).split())
        at = m.end()
        name = m["name"]
        if name is None:
            if m["drop"]:
                pieces.append(" ")
            continue
        name = name.lower()
        if name == "a":
            in_link = not m["close"]
        elif name == "br":
            pieces.append(" ")
        if name not in CUTTING:
            continue
        cut()
        if m["close"]:
            for k in range(len(held) - 1, -1, -1):
                if held[k][0] == name:
                    del held[k:]
                    break
        elif name in HOLDING and not m["rest"].endswith("/"):
            own = 2 if name in PARTS else _named(m["rest"])
            if name in ARTICLES and name not in seen and boxed < 2 and own < 2:
                seen.add(name)
                boxed = 0
            held.append((name, max(article, {"main": 1, "article": 2}.get(name, 0)), max(boxed, own)))
        article, boxed = held[-1][1:] if held else (0, 0)
    tail = page[at:]
    if tail:
        pieces.append(tail)
        if in_link:
            linked += len(html.unescape(tail).split())
    cut()
    out = []
    for k, (text, words, links, inside, box) in enumerate(found):
        before = found[k - 1][1:3] if k else (0, 0.0)
        after = found[k + 1][1:3] if k + 1 < len(found) else (0, 0.0)
        # an article counts more than the main element around it
        level = 0 if not seen else 1 if inside >= (2 if "article" in seen else 1) else -1
        out.append((text, words, links, *before, *after, level, box))
    return out


BLOCK = "struct<text string, " + ", ".join(f"{f} double" for f in FEATURES) + ">"


def blocks_of(page: Column) -> Column:
    """Array of blocks of an HTML column; null and empty pages have none."""

    @F.arrow_udf(f"array<{BLOCK}>")
    def run(column: pa.Array) -> pa.Array:
        fields = [pa.field("text", pa.string()), *[pa.field(f, pa.float64()) for f in FEATURES]]
        sizes, flat = [0], []
        for page in texts(column):
            flat += blocks(page)
            sizes.append(len(flat))
        columns = list(zip(*flat)) if flat else [()] * len(fields)
        values = pa.StructArray.from_arrays(
            [pa.array(columns[0], pa.string()), *[pa.array([float(x) for x in c], pa.float64()) for c in columns[1:]]], fields=fields
        )
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), values)

    return run(page)


def fit(spark: SparkSession) -> str:
    """The trained tree, as Spark ML prints it."""
    rows = [tuple(map(float, line.split())) for line in LABELLED.strip().splitlines()]
    table = spark.createDataFrame(rows, ", ".join(f"{f} double" for f in FEATURES) + ", label double").coalesce(1)
    table = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(table)
    return DecisionTreeClassifier(maxDepth=7, maxBins=128, minInstancesPerNode=2, seed=1).fit(table).toDebugString


def _condition(lines: list[str], block: Column) -> Column:
    line = lines.pop(0).strip()
    if line.startswith("Predict:"):
        return F.lit(float(line.split(":")[1]) > 0.5)
    feature, bound = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
    low = _condition(lines, block)
    lines.pop(0)  # the matching Else
    high = _condition(lines, block)
    return F.when(block[FEATURES[int(feature)]] <= float(bound), low).otherwise(high)


def wanted(block: Column, tree: str) -> Column:
    """Whether the tree takes a block for article text."""
    return _condition(tree.splitlines()[1:], block)


def extract(pages: DataFrame, html_column: str = "html", tree: str | None = None) -> DataFrame:
    """``pages`` with text (the article's blocks joined by two ``\\n``, empty if none), n_chars (its code points) and
    n_blocks (blocks of the whole page); columns of those names are replaced.

    Null and empty pages have the empty text. Repeated pages stay rows of their own.
    """
    tree = tree or fit(pages.sparkSession)
    cut = pages.drop("text", "n_chars", "n_blocks").withColumn("_blocks", blocks_of(F.col(html_column)))
    kept = F.transform(F.filter("_blocks", lambda b: wanted(b, tree)), lambda b: b["text"])
    return (
        cut.withColumn("text", F.array_join(kept, "\n\n"))
        .withColumn("n_chars", F.length("text").cast("bigint"))
        .withColumn("n_blocks", F.array_size("_blocks").cast("bigint"))
        .drop("_blocks")
    )
