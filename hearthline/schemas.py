"""Explicit schemas; nothing is inferred from data."""

from __future__ import annotations

from hearthline import config


LISTING_DDL = (
    "house_id string, title string, region_slug string, prop_url string, decoration_type string, "
    "total_price_wan string, area_sqm string, room_count string, hall_count string, bath_count string, "
    "house_certificate_years string, is_unique_housing boolean, floor_level string, total_floors string, "
    "orientation string, has_elevator boolean, community_id string, community_name string, community_url string, "
    "is_valid boolean, error_message string, list_page_no int, extracted_at string"
)

FACILITY_DDL = (
    "struct<type:string,name:string,distance:string,itemcontent:string,iteminfo:string,coordinate:string,"
    "address:string,sub_type:string>"
)

COMMUNITY_DDL = (
    "community_id string, community_name string, community_url string, tab_item_count int, "
    f"poi_summary struct<{','.join(f'{t}:string' for t in config.POI_TYPES)}>, "
    f"poi_details map<string,array<{FACILITY_DDL}>>, extracted_at string"
)

CRAWL_DDL = (
    "region string, list_page_no int, prop_url string, "
    f"house struct<{','.join(part.strip().replace(' ', ':', 1) for part in LISTING_DDL.split(',') if 'list_page_no' not in part)}>, "
    "community_ref struct<community_id:string,status:string>"
)

SIDECAR_DDL = (
    "community_id string, community struct<community_name:string,community_url:string,tab_item_count:int>, "
    f"poi struct<summary:map<string,int>,details:map<string,array<{FACILITY_DDL}>>>"
)

LINK_INDEX_DDL = (
    "region string, total int, updated_at string, "
    "links array<struct<house_id:string,url:string,title:string,list_page_no:int,extracted_at:string>>"
)

PROGRESS_DDL = "region string, processed_houses array<string>, processed_communities array<string>, last_updated string"

FAILURE_DDL = (
    "record_type string, failure_id string, run_id string, region string, phase string, target_type string, "
    "target_url string, page_no int, house_id string, community_id string, error_type string, error_message string, "
    "failed_at timestamp, retry_count int, resolved boolean, resolved_at timestamp, retried_at timestamp, success boolean"
)

RUN_EVENT_DDL = (
    "event_at timestamp, run_id string, region string, phase string, stage string, status string, "
    "metrics map<string,struct<total:bigint,success:bigint,failed:bigint>>, detail string"
)

MODEL_EVENT_DDL = (
    "created_at string, event string, model_name string, mae double, rmse double, r2 double, mape double, "
    "train_seconds double, predict_seconds double, selected_alpha double"
)

ANSWER_DDL = "house_id string, prompt string, ok boolean, raw string, error string"

METRIC_DDL = "model_name string, mae double, rmse double, r2 double, mape double, cv_mae_mean double, cv_mae_std double"

LABEL_COLUMNS = ("house_id",) + config.ANNOTATED_LABELS
