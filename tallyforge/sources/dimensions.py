"""Small dimensions: geography, elections, registers."""

from __future__ import annotations

from dataclasses import astuple, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The 47 prefectures in official order.
PREFECTURES = (
    "北海道 青森県 岩手県 宮城県 秋田県 山形県 福島県 茨城県 栃木県 群馬県 埼玉県 千葉県 東京都 神奈川県 "
    "新潟県 富山県 石川県 福井県 山梨県 長野県 岐阜県 静岡県 愛知県 三重県 滋賀県 京都府 大阪府 兵庫県 奈良県 "
    "和歌山県 鳥取県 島根県 岡山県 広島県 山口県 徳島県 香川県 愛媛県 高知県 福岡県 佐賀県 長崎県 熊本県 大分県 "
    "宮崎県 鹿児島県 沖縄県"
).split()
# The 11 blocks and their prefectures.
BLOCKS = {
    "北海道": "北海道",
    "東北": "青森県 岩手県 宮城県 秋田県 山形県 福島県",
    "北関東": "茨城県 栃木県 群馬県 埼玉県",
    "南関東": "千葉県 神奈川県 山梨県",
    "東京都": "東京都",
    "北陸信越": "新潟県 富山県 石川県 福井県 長野県",
    "東海": "岐阜県 静岡県 愛知県 三重県",
    "近畿": "滋賀県 京都府 大阪府 兵庫県 奈良県 和歌山県",
    "中国": "鳥取県 島根県 岡山県 広島県 山口県",
    "四国": "徳島県 香川県 愛媛県 高知県",
    "九州": "福岡県 佐賀県 長崎県 熊本県 大分県 宮崎県 鹿児島県 沖縄県",
}


def geography(spark: SparkSession) -> DataFrame:
    """(prefecture, pref_idx, block): 47 rows, always small enough to broadcast."""
    block_of = {p: b for b, members in BLOCKS.items() for p in members.split()}
    rows = [(p, i, block_of[p]) for i, p in enumerate(PREFECTURES, 1)]
    return spark.createDataFrame(rows, "prefecture string, pref_idx int, block string")


def is_prefecture(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.isin(*PREFECTURES), F.lit(False))


@dataclass(frozen=True)
class ElectionConfig:
    election_id: str
    ordinal: int
    election_date: str
    smd_seats: int
    pr_seats: int
    has_gender_column: bool


# One row per election.
ELECTIONS = (
    ElectionConfig("r08-02-08", 51, "2026-02-08", 289, 176, False),
    ElectionConfig("r06-10-27", 50, "2024-10-27", 289, 176, False),
    ElectionConfig("r03-10-31", 49, "2021-10-31", 289, 176, False),
    ElectionConfig("h29-10-22", 48, "2017-10-22", 289, 176, True),
    ElectionConfig("h26-12-14", 47, "2014-12-14", 295, 180, True),
)


def elections(spark: SparkSession, configs=ELECTIONS) -> DataFrame:
    df = spark.createDataFrame(
        [astuple(c) for c in configs],
        "election_id string, ordinal int, election_date string, smd_seats int, pr_seats int, has_gender_column boolean",
    )
    return df.withColumn("election_date", F.col("election_date").cast("date"))


def election_index(elections_df: DataFrame) -> DataFrame:
    """Published index, newest first. One row per election, so one sorted file is fine."""
    return elections_df.select(
        F.col("election_id").alias("id"), "ordinal", F.col("election_date").alias("date"),
        F.col("smd_seats").alias("smdSeats"), F.col("pr_seats").alias("prSeats"),
        (F.col("smd_seats") + F.col("pr_seats")).alias("totalSeats"),
    ).orderBy(F.desc("ordinal"))


def register(spark: SparkSession, rows=()) -> DataFrame:
    """Known discrepancies: (election_id, check_id, subject, reason)."""
    return spark.createDataFrame(list(rows), "election_id string, check_id string, subject string, reason string")


# Category names allowed per election.
ALLOWED_VALUES = {
    "r08-02-08": (
        "自由民主党 中道改革連合 日本維新の会 国民民主党 参政党 日本共産党 れいわ新選組 減税日本・ゆうこく連合 日本保守党 "
        "社会民主党 チームみらい 安楽死制度を考える会 立憲民主党 公明党 無所属 再生の道 無所属連合 日本大和党 世界平和党 "
        "一番星 核融合党 未来進歩党 日本自由党 心の党 諸派"
    ),
    "r06-10-27": (
        "自由民主党 立憲民主党 日本維新の会 公明党 日本共産党 国民民主党 れいわ新選組 社会民主党 参政党 日本保守党 "
        "みんなでつくる党 安楽死制度を考える会 無所属 諸派 お金をみんなへシン独立党 川口自警団 自民党を終わらせる党 心の党 鼎立の党"
    ),
    "r03-10-31": (
        "自由民主党 立憲民主党 日本維新の会 公明党 日本共産党 国民民主党 れいわ新選組 社会民主党 "
        "ＮＨＫと裁判してる党弁護士法７２条違反で 支持政党なし 新党やまと 政権交代によるコロナ対策強化新党 日本第一党 "
        "新党くにもり 希望の党 新党日本こころ 改革未来党 愛地球党 日本成功党 改新党 無所属 諸派"
    ),
    "h29-10-22": (
        "自由民主党 立憲民主党 希望の党 公明党 日本共産党 日本維新の会 社会民主党 日本のこころ 幸福実現党 支持政党なし "
        "世界経済共同体党 労働の解放をめざす労働者党 新党大地 フェア党 犬丸勝子と共和党 都政を革新する会 新党憲法９条 "
        "議員報酬ゼロを実現する会 長野県を日本一好景気にする会 日本新党 無所属 諸派"
    ),
    "h26-12-14": (
        "自由民主党 民主党 維新の党 公明党 日本共産党 次世代の党 生活の党 社会民主党 新党改革 幸福実現党 支持政党なし "
        "減税日本 世界経済共同体党 犬丸勝子と共和党 みらい党 無所属 諸派"
    ),
}
# Discrepancies inside the published source itself.
KNOWN_DISCREPANCIES = (
    ("h29-10-22", "B1", "沖縄県2", "candidate votes exceed ten times the printed point by 105"),
    ("h29-10-22", "C3", "沖縄県", "candidate votes exceed the printed valid votes by 105"),
)


def allowed_values(spark: SparkSession, values=ALLOWED_VALUES) -> DataFrame:
    rows = [(e, name) for e, names in values.items() for name in names.split()]
    return spark.createDataFrame(rows, "election_id string, party string")


def known_discrepancies(spark: SparkSession) -> DataFrame:
    return register(spark, KNOWN_DISCREPANCIES)
