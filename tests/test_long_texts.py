import time

from loomtext.functions import normalize
from pyspark.sql import functions as F


def test_orphans_of_many_lines_are_sought_once(spark):
    """Without a closing brace after them, lines are not each tried to the end of the text: 150,000 lines took minutes."""
    lines = "a\n" * 150_000
    rows = spark.createDataFrame([(1, lines), (2, "a\nb }} c }}}d\n" + lines), (3, "x {{o\n y }\nz }} w {q\nr }}"), (4, None)], "id int, text string").repartition(1)
    start = time.time()
    got = dict(rows.select("id", normalize.without_templates(F.col("text"))).collect())
    assert time.time() - start < 20
    assert got == {1: lines, 2: "d\n" + lines, 3: " w {q\n", 4: None}


def test_tails_begin_at_any_line(spark):
    said = ["Voir aussi\nx", "\n \nvoir aussi", "a \n\n Références \nx", "a\nréférences b", "a voir aussi", "", "a ", None, "é\nVOIR AUSSI\nb\nvoir aussi"]
    rows = spark.createDataFrame(list(enumerate(said)), "i int, text string")
    got = dict(rows.select("i", normalize.wiki_tail_cut(F.col("text"))).collect())
    assert [got[i] for i in range(len(said))] == ["", "", "a", "a\nréférences b", "a voir aussi", "", "a ", None, "é"]
