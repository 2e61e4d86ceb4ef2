"""Input and result schemas as DDL strings. All columns are nullable."""

# Column names and order of the input tables.
USER_VISIT_ACTION = (
    "date string, user_id bigint, session_id string, page_id bigint, action_time string, "
    "search_keyword string, click_category_id bigint, click_product_id bigint, "
    "order_category_ids string, order_product_ids string, "
    "pay_category_ids string, pay_product_ids string, city_id bigint"
)
USER_INFO = (
    "user_id bigint, username string, name string, age int, professional string, "
    "city string, sex string"
)
PRODUCT_INFO = "product_id bigint, product_name string, extend_info string"
TASK = (
    "task_id bigint, task_name string, create_time string, start_time string, "
    "finish_time string, task_type string, task_status string, task_param string"
)
CITY_INFO = "city_id bigint, city_name string, area string"

# Column names and order of the result tables.
SESSION_RANDOM_EXTRACT = (
    "taskid bigint, sessionid string, startTime string, searchKeywords string, "
    "clickCategoryIds string"
)
SESSION_DETAIL = (
    "taskid bigint, userid bigint, sessionid string, pageid bigint, actionTime string, "
    "searchKeyword string, clickCategoryId bigint, clickProductId bigint, "
    "orderCategoryIds string, orderProductIds string, payCategoryIds string, "
    "payProductIds string"
)
TOP10_CATEGORY = (
    "taskid bigint, categoryid bigint, clickCount bigint, orderCount bigint, payCount bigint"
)
TOP10_CATEGORY_SESSION = (
    "taskid bigint, categoryid bigint, sessionid string, clickCount bigint"
)
PAGE_SPLIT_CONVERT_RATE = "taskid bigint, convertRate string"
AREA_TOP3_PRODUCT = (
    "taskid bigint, area string, areaLevel string, productid bigint, cityInfos string, "
    "clickCount bigint, productName string, productStatus string"
)
AD_USER_CLICK_COUNT = "date string, user_id bigint, ad_id bigint, click_count bigint"
AD_BLACKLIST = "user_id bigint"
AD_STAT = "date string, province string, city string, ad_id bigint, click_count bigint"
AD_PROVINCE_TOP3 = "date string, province string, ad_id bigint, click_count bigint"
AD_CLICK_TREND = "date string, hour string, minute string, ad_id bigint, click_count bigint"

# Lines of the ad log that are no clicks, and what became of all lines.
REJECTED_AD_LINES = "value string, reason string, line_count bigint"
AD_LINE_OUTCOMES = "outcome string, line_count bigint"
