"""Lists of paths, in the order that they were given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def from_list(spark: SparkSession, paths: list[str], src_no: int = 0) -> DataFrame:
    return spark.createDataFrame([(src_no, k, p) for k, p in enumerate(paths)], "src_no int, item_no long, path string")


def split_tokens(texts: DataFrame, column: str, separator: str = "\n", src_no: int = 0) -> DataFrame:
    """src_no, item_no, path: tokens of a list, without trailing carriage returns; blank ones go."""
    parts = F.split(F.col(column), separator, -1)
    rows = texts.select(F.posexplode(parts).alias("item_no", "path"))
    return rows.select(F.lit(src_no).alias("src_no"), F.col("item_no").cast("long").alias("item_no"), F.regexp_replace("path", "\r$", "").alias("path")).where("path <> ''")


def from_file(spark: SparkSession, path: str, null_separated: bool = False, src_no: int = 0) -> DataFrame:
    text = spark.read.option("wholetext", "true").text(path)
    return split_tokens(text, "value", "\0" if null_separated else "\n", src_no)


def queued(*sources: DataFrame) -> DataFrame:
    """All sources one after another."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return out.orderBy("src_no", "item_no")


def taken(queue: DataFrame, n: int) -> DataFrame:
    """The first n paths of a queue, each with its turn from 1 on; the others are left."""
    order = Window.orderBy("src_no", "item_no")  # over n rows
    return queue.orderBy("src_no", "item_no").limit(n).withColumn("turn", F.row_number().over(order))


def left(queue: DataFrame, done: int) -> DataFrame:
    """n_left and n_done of a queue after that many were taken."""
    n = F.count(F.lit(1))
    return queue.agg(F.greatest(n - done, F.lit(0)).alias("n_left"), F.least(n, F.lit(done)).cast("long").alias("n_done"))


# Colours by name, in groups of one hue.
_NAMES = """
black 000000 white FFFFFF red FF0000 green 00FF00 blue 0000FF cyan 00FFFF magenta FF00FF yellow FFFF00 gray BEBEBE navy 000080
snow FFFAFA ghostwhite F8F8FF whitesmoke F5F5F5 gainsboro DCDCDC floralwhite FFFAF0 oldlace FDF5E6 linen FAF0E6 antiquewhite FAEBD7
papayawhip FFEFD5 blanchedalmond FFEBCD bisque FFE4C4 peachpuff FFDAB9 navajowhite FFDEAD moccasin FFE4B5 cornsilk FFF8DC ivory FFFFF0
lemonchiffon FFFACD seashell FFF5EE honeydew F0FFF0 mintcream F5FFFA azure F0FFFF aliceblue F0F8FF lavender E6E6FA lavenderblush FFF0F5
mistyrose FFE4E1 darkslategray 2F4F4F dimgray 696969 slategray 708090 lightslategray 778899 lightgray D3D3D3 darkgray A9A9A9
midnightblue 191970 navyblue 000080 cornflowerblue 6495ED darkslateblue 483D8B slateblue 6A5ACD mediumslateblue 7B68EE
lightslateblue 8470FF mediumblue 0000CD royalblue 4169E1 dodgerblue 1E90FF deepskyblue 00BFFF skyblue 87CEEB lightskyblue 87CEFA
steelblue 4682B4 lightsteelblue B0C4DE lightblue ADD8E6 powderblue B0E0E6 paleturquoise AFEEEE darkturquoise 00CED1 mediumturquoise 48D1CC
turquoise 40E0D0 lightcyan E0FFFF cadetblue 5F9EA0 mediumaquamarine 66CDAA aquamarine 7FFFD4 darkgreen 006400 darkolivegreen 556B2F
darkseagreen 8FBC8F seagreen 2E8B57 mediumseagreen 3CB371 lightseagreen 20B2AA palegreen 98FB98 springgreen 00FF7F lawngreen 7CFC00
chartreuse 7FFF00 mediumspringgreen 00FA9A greenyellow ADFF2F limegreen 32CD32 yellowgreen 9ACD32 forestgreen 228B22 olivedrab 6B8E23
darkkhaki BDB76B khaki F0E68C palegoldenrod EEE8AA lightgoldenrodyellow FAFAD2 lightyellow FFFFE0 gold FFD700 lightgoldenrod EEDD82
goldenrod DAA520 darkgoldenrod B8860B rosybrown BC8F8F indianred CD5C5C saddlebrown 8B4513 sienna A0522D peru CD853F burlywood DEB887
beige F5F5DC wheat F5DEB3 sandybrown F4A460 tan D2B48C chocolate D2691E firebrick B22222 brown A52A2A darksalmon E9967A salmon FA8072
lightsalmon FFA07A orange FFA500 darkorange FF8C00 coral FF7F50 lightcoral F08080 tomato FF6347 orangered FF4500 hotpink FF69B4
deeppink FF1493 pink FFC0CB lightpink FFB6C1 palevioletred DB7093 maroon B03060 mediumvioletred C71585 violetred D02090 violet EE82EE
plum DDA0DD orchid DA70D6 mediumorchid BA55D3 darkorchid 9932CC darkviolet 9400D3 blueviolet 8A2BE2 purple A020F0 mediumpurple 9370DB
thistle D8BFD8 darkblue 00008B darkcyan 008B8B darkmagenta 8B008B darkred 8B0000 lightgreen 90EE90
"""


def _colors() -> dict[str, int]:
    """The names, `grey` for `gray`, and the grays from 0 to 100 in the hundred."""
    words = _NAMES.split()
    out = {n: int(v, 16) for n, v in zip(words[::2], words[1::2], strict=True)}
    out |= {f"gray{k}": (k * 255 + 50) // 100 * 0x010101 for k in range(101)}
    return out | {n.replace("gray", "grey"): v for n, v in out.items() if "gray" in n}


COLORS = _colors()


def named_color(df: DataFrame, column: str, name: str = "rgb") -> DataFrame:
    """df with the colour of a name, whatever its case and spaces; null for unknown names."""
    table = df.sparkSession.createDataFrame(list(COLORS.items()), "color_name string, color_rgb long")
    key = F.lower(F.regexp_replace(column, " ", ""))
    return df.join(F.broadcast(table), key == F.col("color_name"), "left").withColumnRenamed("color_rgb", name).drop("color_name")
