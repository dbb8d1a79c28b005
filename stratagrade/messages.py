"""Texts of errors and warnings that callers rely on.

Fixed values: the wording of the error contract, by what is wrong.
"""

NOT_FOUND = "{what} not found: {path}"
INVALID_JSON = "Invalid {what} JSON: {path}: {reason}"
OUTPUT_EXISTS = "Refusing to overwrite existing output: {paths}. Pass --overwrite to replace it."
BAD_POLICY = "{name} must be {choices}"
DATASET_NAME = "dataset must contain only letters, numbers, underscores, and hyphens"
UNSUPPORTED_INPUT = "Unsupported input type '{kind}'. Expected .csv or .xlsx."
EMPTY_INPUT = "Input dataset is empty"
SEVERAL_INPUTS = "Multiple {what} files found: {paths}. Select one with --input."
NO_INPUT = "No {what} file found. Expected one of: {names}."

MAPPING_SHAPE = "Mapping JSON must be a non-empty object"
MAPPING_STRINGS = "Every mapping key and value must be a string"
MAPPING_EMPTY = "Mapping keys and values cannot be empty"
MAPPING_TWICE = "Duplicate mapping source after trimming: {name!r}"
MAPPING_TARGETS = "Unsupported mapping targets: {names}"
MAPPING_SAME_TARGET = "Multiple source columns map to: {names}"
MAPPING_SOURCES = "Mapped source columns not found: {names}"
MAPPING_CLASH = "Mapped columns already exist: {names}"
OTHER_HEADER = "The header of {path} is not that of {first}"
DUPLICATE_COLUMNS = "Duplicate source columns: {names}"
MAPPING_NEEDED = "either --dataset or --mapping is required"
MAPPING_UNKNOWN = "Mapping for dataset '{name}' not found. Pass --mapping."

EMPTY_FIELD_NAME = "field_name is empty at source rows: {rows}"
SKIPPING_ROWS = "Skipping {count} row(s): {reason}"
NO_ROWS_LEFT = "No valid rows remain after skipping empty field_name values"
CONFLICTS = "Conflicting labels found for the same field: {names}"
KEEPING_CONFLICTS = "Keeping conflicting records: {reason}"

JSON_LIST = "{what} JSON must contain a list"
JSON_OBJECTS = "Every dataset item must be a JSON object"
RATIO_RANGE = "Every split ratio must be between 0 and 1"
RATIO_SUM = "train, val, and test ratios must sum to 1"
RATIO_TRAIN = "train ratio must be greater than zero"
FEW_GROUPS = "Only {groups} groups are available for {splits} non-empty splits"
GROUP_KEY_NEEDED = "group_key is required for a group split"
GROUP_MISSING = "group key '{key}' is missing or empty at item(s): {items}"
GROUP_SCALAR = "group key '{key}' must resolve to a scalar at item {item}"
SKIPPING_RECORDS = "Skipping {count} record(s): {reason}"
NO_RECORDS_LEFT = "No records remain after skipping empty group key '{key}'"

CORPUS_NOT_FOUND = "Corpus source not found: {path}"
CORPUS_KIND = "Corpus source must be an .xlsx or .csv file"
CORPUS_COLUMNS = "Corpus source is missing column(s): {names}"
CORPUS_MISSING = "Missing {names} at source row {row}"
FLAT_MISSING = "Missing content or leaf label at source row {row}"
SKIPPING_CORPUS = "Skipping {count} corpus row(s) with missing label/content"
NO_DOCUMENTS = "No valid corpus documents were generated"
ID_COLLISION = "Corpus document ID collision detected"
PROCESSED_PARTS = "Processed item {item} has invalid classification/grading"
FLAT_FIELDS = "Corpus item {item} is missing: {names}"

EXPORT_PART = "Item {item} in {path} has invalid {part}"
EXPORT_FIELDS = "Item {item} in {path} is missing {part} fields: {names}"
NOTHING_LABELED = "No labeled records available in {path}"
BAD_ARCHIVE = "{name} of the workbook is damaged, encrypted or packed by a method that workbooks do not use"
SHEET_ELEMENTS = "A cut of the workbook has {found} elements {tag}, not {n}"
