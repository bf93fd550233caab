"""Fixed values and run settings."""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# Column sets, weights, word lists and settings that results depend on.
# ---------------------------------------------------------------------------

POI_TYPES = ("bank", "bus", "subway", "school", "restaurant", "shop", "hospital")

POI_WEIGHTS = {
    "bank": 0.6,
    "bus": 1.0,
    "subway": 1.5,
    "school": 1.4,
    "restaurant": 0.7,
    "shop": 0.8,
    "hospital": 1.2,
}

POI_KEYWORDS = {
    "bank": "银行",
    "bus": "公交",
    "subway": "地铁",
    "school": "学校",
    "restaurant": "餐饮",
    "shop": "购物",
    "hospital": "医院",
}

POI_NOISE_NAMES = ("银行", "公交", "地铁", "学校", "餐饮", "购物", "医院", "地铁找房", "青山湖二手房", "生活配套", "轨道交通")

POI_SUB_TYPES = ("ATM", "幼儿园", "小学", "中学", "三甲", "社区医院", "卫生站", "商场", "超市")

TARGET = "total_price_wan"

BASE_NUMERIC = (
    "area_sqm", "room_count", "hall_count", "bath_count", "total_floors", "house_certificate_years",
    "floor_level_score", "floor_ratio_proxy", "area_per_room", "layout_density",
    "poi_bank_count", "poi_bus_count", "poi_subway_count", "poi_school_count", "poi_restaurant_count",
    "poi_shop_count", "poi_hospital_count", "poi_total_count", "accessibility_index",
)

DERIVED_NUMERIC = (
    "poi_balance_score", "transit_medical_ratio", "education_commerce_ratio", "area_layout_efficiency",
    "room_area_interaction", "bath_room_ratio", "region_accessibility_interaction", "floor_area_interaction",
)

NUMERIC = BASE_NUMERIC + DERIVED_NUMERIC

CATEGORICAL = (
    "region_slug", "decoration_type", "orientation", "floor_level", "has_elevator", "is_unique_housing", "house_layout",
)

RAW_NUMERIC = ("area_sqm", "room_count", "hall_count", "bath_count", "total_floors")

FLOOR_SCORES = (("低", 0.2), ("中", 0.5), ("高", 0.8))
FLOOR_DEFAULT = 0.5

CERTIFICATE_PATTERN = "^满?([0-9]+|[一二两三四五六七八九十]{1,2})年?$"
CN_DIGITS = {"一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10}

PRICE_BANDS = ((0.0, 60.0, "[0,60)"), (60.0, 100.0, "[60,100)"), (100.0, 150.0, "[100,150)"), (150.0, None, "[150,inf)"))

TITLE_KEYWORDS = {
    "subway": ["地铁", "地铁口", "地铁站", "地铁房", "轨道交通"],
    "bus_hub": ["公交", "公交站", "交通便利", "出行方便"],
    "school_district": ["学区", "学位", "名校", "重点学校", "学区房"],
    "school_nearby": ["学校", "幼儿园", "小学", "中学", "附中"],
    "river_view": ["江景", "湖景", "河景", "水景", "一线江景"],
    "park_nearby": ["公园", "绿化", "生态"],
    "high_floor_view": ["视野", "无遮挡", "景观房", "观景"],
    "luxury_decor": ["精装", "豪装", "豪华装修", "精装修", "品牌装修", "装修好", "精装好房"],
    "simple_decor": ["简装", "简单装修", "普通装修"],
    "rough": ["毛坯", "清水"],
    "urgent_sale": ["急售", "急卖", "急！急！急！", "急售房源", "特价", "房东急售"],
    "below_market": ["低于市场价", "低于市价", "捡漏", "抄底", "白菜价"],
    "sincere": ["诚心", "诚意", "诚心出售", "诚意出", "房东诚心", "诚心卖"],
    "quality_community": ["品质", "高档", "高端", "豪华小区", "豪宅"],
    "new_community": ["次新", "新小区", "新房", "次新房", "小区新", "次新小区"],
    "old_community": ["老小区", "老旧", "老房", "房龄老"],
    "low_density": ["低密度", "低密", "密度低", "居住密度低"],
    "good_lighting": ["采光好", "采光", "南向采光", "正南朝向", "朝南", "南北通透", "朝向好"],
    "elevator": ["电梯", "电梯房", "带电梯", "有电梯"],
    "shopping": ["商圈", "商场", "超市", "购物方便", "购物", "配套完善", "配套成熟"],
    "direct_seller": ["房东直卖", "业主直卖", "直卖"],
    "price_negotiable": ["价格可议", "可议价", "价格美丽", "合适可谈", "可谈", "价格可商量"],
    "garage": ["车库", "车位", "车位充足", "带车位", "有车位"],
    "good_floor": ["高楼层", "中间好楼层", "中间楼层", "好楼层", "楼层好", "高层"],
    "duplex": ["复式", "跃层", "loft"],
    "garden": ["花园", "露台", "晒台", "院子", "天台"],
    "furnished": ["送家具", "带家具", "家具齐全", "拎包入住"],
    "double_bath": ["双卫", "双卫生间", "双卫格局", "两个卫生间"],
    "board_building": ["板楼", "板式建筑"],
}

# The annotated label set has every title label but this one.
RULE_ONLY_LABEL = "bus_hub"

REQUIRED_LISTING_FIELDS = (
    "title", "total_price_wan", "area_sqm", "room_count", "hall_count", "bath_count", "decoration_type",
    "house_certificate_years", "is_unique_housing", "floor_level", "total_floors", "orientation",
    "has_elevator", "community_name", "community_id", "community_url",
)

POLYNOMIAL_CORE = ("area_sqm", "poi_subway_count", "accessibility_index", "poi_balance_score", "room_count", "floor_level_score")

# ---------------------------------------------------------------------------

ANNOTATED_LABELS = tuple(name for name in TITLE_KEYWORDS if name != RULE_ONLY_LABEL)
FEATURE_COLUMNS = ("house_id", "community_id", "extracted_at", TARGET) + NUMERIC + CATEGORICAL


@dataclass(frozen=True)
class StudyConfig:
    """Settings of one study run."""

    run_id: str = "run"
    seed: int = 42
    test_size: float = 0.2
    folds: int = 3
    sample_limit: int | None = None
    split_mode: str = "time"

    def __post_init__(self) -> None:
        if not 0.0 < self.test_size < 1.0:
            raise ValueError("test_size must lie between 0 and 1")
        if self.folds < 2:
            raise ValueError("folds must be at least 2")
        if self.split_mode not in ("time", "random"):
            raise ValueError("split_mode must be 'time' or 'random'")
