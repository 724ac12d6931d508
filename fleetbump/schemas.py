"""Schemas of the landed tables, the rule catalogue and the tracking document."""

REPOS = (
    "id string, name string, path_with_namespace string, web_url string, default_branch string, "
    "forked_from struct<id:string>, archived boolean, owned boolean, member boolean, description string, ord bigint"
)
TREE = "repo_id string, ref string, type string, name string, path string, ord bigint"
LANDED_FILES = "repo_id string, ref string, path string, content_base64 string"
BRANCHES = "repo_id string, name string, commit struct<committed_date:string>, ord bigint"
MERGE_REQUESTS = (
    "repo_id string, iid string, title string, state string, web_url string, "
    "source_branch string, target_branch string, ord bigint"
)
SEARCH_HITS = "repo_id string, term string, path string, filename string, ord bigint"
TARGETS = "ord int, name string, version string"

TRACKED = (
    "repository_id string, repository_name string, merge_request_url string, merge_request_iid string, "
    "created_at string, was_existing boolean, existed boolean, status string, last_checked string, "
    "package_name string, new_version string, target_branch string, source_branch string, "
    "modified_files array<string>"
)
TRACKING_META = (
    "generated_at string, package_name string, new_version string, total_repositories bigint, "
    "successful_updates bigint, last_updated string"
)
TRACKING = f"metadata struct<{TRACKING_META}>, merge_requests array<struct<{TRACKED}>>, _corrupt string"

NODE = (
    "struct<type:string,method_name:string,class_name:string,identifier:string,containing_type:string,"
    "containing_namespace:string,attributes:array<string>,parameters:array<struct<type:string,name:string>>>"
)
ACTION = (
    "struct<type:string,strategy:string,replacement_method:string,replacement_code:string,replacement_type:string,"
    "attribute_name:string,argument_name:string,preserve_parameters:boolean,preserve_variable_names:boolean>"
)
RULES = f"array<struct<name:string,target_nodes:array<{NODE}>,action:{ACTION}>>"
CONDITIONS = "array<struct<type:string,version:string,max_version:string>>"
MIGRATION = (
    f"id string, package_name string, description string, version_conditions {CONDITIONS}, rules {RULES}"
)
CATALOGUE_FILE = f"migrations array<struct<{MIGRATION}>>"
MIGRATIONS = f"{MIGRATION}, ord int"

# The keys a target node may carry; others are reported, not used.
NODE_KEYS = (
    "type",
    "method_name",
    "class_name",
    "identifier",
    "containing_type",
    "containing_namespace",
    "attributes",
    "parameters",
)

MIGRATION_RESULT = (
    "success boolean, modified_files array<string>, applied_rules array<string>, errors array<string>, "
    "summary string, _corrupt string"
)
ACTION_LOG = "txn_id string, seq bigint, description string, outcome string, error string"
REQUEST_LOG = "request_id bigint, key string, ts timestamp, status_code int, retry_after string, attempt int"
