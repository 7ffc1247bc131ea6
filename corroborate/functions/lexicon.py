"""Word lists, tables and thresholds that results depend on."""

# --- fixed values: grounding -------------------------------------------------

STOP_WORDS = [
    "the", "a", "an", "is", "are", "was", "were", "in", "on", "at",
    "to", "for", "of", "and", "or", "but", "with", "by", "from",
]
NEGATIONS = ["not", "no", "never", "without", "cannot"]
CLAIM_PROHIBITIONS = ["avoid", "contraindication", "should not", "must not", "do not", "don't"]
EVIDENCE_PROHIBITIONS = ["contraindication", "avoid", "should not", "must not"]
NLI_LABELS = ["contradiction", "neutral", "entailment"]

TOPICS = {
    "medical": ["diabetes", "medication", "patient", "prescription", "disease", "treatment"],
    "legal": ["contract", "employment", "law", "agreement", "clause", "compliance"],
    "financial": ["investment", "stock", "revenue", "profit", "accounting", "tax"],
    "technical": ["software", "api", "code", "algorithm", "database", "server"],
}

STATUS_COLOURS = {
    "supported": "#d4edda",
    "contradicted": "#f8d7da",
    "unverifiable": "#fff3cd",
}

# --- fixed values: column names ----------------------------------------------

ABBREVIATIONS_A = {
    "cust": "customer", "prod": "product", "qty": "quantity", "amt": "amount",
    "dt": "date", "ts": "timestamp", "num": "number", "no": "number",
    "id": "identifier", "desc": "description", "addr": "address",
    "tel": "telephone", "ph": "phone", "fname": "first name",
    "lname": "last name", "dob": "date of birth", "emp": "employee",
    "dept": "department", "mgr": "manager", "org": "organization",
    "cat": "category", "subcat": "subcategory", "inv": "invoice",
    "ord": "order", "pmt": "payment", "txn": "transaction",
    "acct": "account", "bal": "balance", "curr": "currency",
    "stat": "status", "flg": "flag", "ind": "indicator", "cnt": "count",
    "tot": "total", "avg": "average", "min": "minimum", "max": "maximum",
    "src": "source", "tgt": "target", "dest": "destination",
    "msg": "message", "err": "error", "ref": "reference",
    "seq": "sequence", "ver": "version", "upd": "update", "crt": "create",
    "del": "delete", "mod": "modified",
}

# One-word abbreviations of the second normaliser. Longer dictionaries, and
# abbreviations of several words, are passed in as a table (see names.Dictionary).
ABBREVIATIONS_B = {
    "cust": "customer", "cid": "customer_id", "custid": "customer_id",
    "fname": "first_name", "firstname": "first_name", "first": "first_name",
    "lname": "last_name", "lastname": "last_name", "last": "last_name",
    "mname": "middle_name", "middlename": "middle_name",
    "dob": "date_of_birth", "bday": "birthday", "bd": "birth_date",
    "birthdate": "date_of_birth", "ssn": "social_security_number",
    "sin": "social_insurance_number", "ph": "customer",
    "tel": "telephone", "mob": "mobile", "cell": "cellphone",
    "phoneno": "phone_number", "addr": "address",
    "address1": "address_line_1", "address2": "address_line_2",
    "addr1": "address_line_1", "addr2": "address_line_2",
    "zip": "postal_code", "zipcode": "postal_code", "postal": "postal_code",
    "pcode": "postal_code", "email": "email_address",
    "mail": "email_address", "emailaddr": "email_address",
    "ctry": "country", "cntry": "country", "cnt": "country",
    "prov": "province", "reg": "region", "st": "state",
    "state": "state_code", "lat": "latitude", "lng": "longitude",
    "lon": "longitude", "ord": "order", "oid": "order_id",
    "txn": "transaction", "trans": "transaction", "trx": "transaction",
    "inv": "invoice", "invno": "invoice_number", "qty": "quantity",
    "amt": "amount", "tot": "total", "disc": "discount", "pct": "percent",
    "percentage": "percent", "prod": "product", "pid": "product_id",
    "prodid": "product_id", "sku": "stock_keeping_unit", "cat": "category",
    "categ": "category", "desc": "description", "descr": "description",
    "acct": "account", "acc": "account", "accno": "account_number",
    "bal": "balance", "curr": "currency", "ccy": "currency",
    "cr": "credit", "dr": "provider", "pmt": "payment", "pymt": "payment",
    "dt": "date", "tm": "time", "ts": "timestamp", "yr": "year",
    "mo": "month", "dy": "day", "createdt": "created_at",
    "updatedt": "updated_at", "modifieddt": "updated_at", "sts": "status",
    "stat": "status", "flg": "flag", "actv": "active",
    "inactv": "inactive", "status": "is_active", "enabled": "is_active",
    "disabled": "is_inactive", "emp": "employee", "eid": "employee_id",
    "empid": "employee_id", "mgr": "manager", "dept": "department",
    "sal": "salary", "id": "identifier", "pk": "primary_key",
    "fk": "foreign_key", "seq": "sequence", "num": "number",
    "no": "number", "nbr": "number", "src": "source", "tgt": "target",
    "dest": "destination", "ref": "reference", "cfg": "configuration",
    "config": "configuration", "loc": "location", "geo": "geography",
    "img": "image", "pic": "picture", "photo": "image", "msg": "message",
    "txt": "text", "mid": "member_id", "sid": "session_id",
    "uid": "user_id", "grp": "group", "typ": "type", "std": "standard",
    "ext": "extension", "pt": "patient", "pat": "patient",
    "mrn": "medical_record_number", "doc": "provider", "phy": "provider",
    "npi": "national_provider_identifier", "appt": "appointment",
    "enc": "encounter", "disposition": "discharge_disposition",
    "diag": "diagnosis", "dx": "diagnosis", "med": "medication",
    "rx": "medication_order", "lab": "laboratory", "proc": "procedure",
    "vital": "vital_sign", "bmi": "body_mass_index", "ins": "insurance",
    "bill": "billing_claim", "adjustments": "adjustment_amount",
    "allergy": "patient_allergy", "allergen": "allergen_name",
    "reaction": "reaction_description", "severity": "severity_level",
    "verified": "is_verified", "room": "facility_room",
    "equipment": "equipment_list", "pol": "policy", "clm": "claim",
    "agt": "agent", "hosp": "hospital", "nom": "beneficiary",
    "policyholders": "customers",
}

NAME_PREFIXES = [
    "cust_", "customer_", "usr_", "user_", "emp_", "employee_", "ord_", "order_",
    "prod_", "product_", "inv_", "invoice_", "acct_", "account_", "item_", "tbl_",
    "src_", "tgt_", "amb_", "ph_", "pol_", "clm_", "agt_", "hosp_", "txn_", "nom_",
]

# Pairs with a known score; more are passed in as a table.
KNOWN_PAIRS = [
    ("cust_id", "customer_id", 0.98),
    ("cust_fname", "first_name", 0.98),
    ("cust_lname", "last_name", 0.98),
    ("cust_email", "email_address", 0.98),
    ("cust_ph", "phone_number", 0.98),
    ("cust_addr", "street_address", 0.98),
    ("cust_city", "city", 0.98),
    ("cust_state", "state_code", 0.98),
    ("cust_zip", "postal_code", 0.98),
    ("cust_type", "customer_type", 0.98),
    ("cust_status", "is_active", 0.95),
    ("created_dt", "created_at", 0.98),
    ("modified_dt", "updated_at", 0.98),
    ("fname", "first_name", 0.98),
    ("lname", "last_name", 0.98),
]

SEMANTIC_GROUPS = {
    "name": ["name", "title", "label", "designation", "first_name", "last_name", "full_name"],
    "identifier": ["id", "code", "key", "number", "identifier", "no", "num"],
    "description": ["description", "desc", "details", "notes", "comments", "remarks"],
    "created": ["created_at", "created_date", "created_dt", "create_date", "create_dt", "createdt", "creation_date"],
    "updated": ["updated_at", "updated_date", "updated_dt", "modified_at", "modified_date", "modified_dt", "update_date", "modify_date"],
    "amount": ["amount", "total", "sum", "value", "price", "cost", "amt"],
    "status": ["status", "state", "condition", "flag", "is_active", "active", "enabled"],
    "email": ["email", "mail", "email_address", "e_mail", "emailaddr"],
    "phone": ["phone", "telephone", "mobile", "cell", "contact_number", "phone_number", "ph", "mob"],
    "address": ["address", "location", "street", "addr", "street_address", "addr1", "addr2"],
    "postal": ["zip", "zip_code", "postal_code", "zipcode", "postcode", "pin", "pin_code"],
    "customer": ["customer", "cust", "client", "buyer", "account_holder", "policyholder", "ph"],
    "patient": ["patient", "pt", "pat", "client", "member"],
    "provider": ["provider", "physician", "doctor", "dr", "doc", "clinician"],
    "encounter": ["encounter", "visit", "admission", "enc"],
    "diagnosis": ["diagnosis", "diag", "dx", "condition", "illness"],
    "medication": ["medication", "med", "rx", "drug", "prescription"],
    "procedure": ["procedure", "proc", "operation", "surgery", "intervention"],
    "laboratory": ["lab", "laboratory", "test", "result"],
    "policy": ["policy", "pol", "insurance", "coverage", "plan"],
    "claim": ["claim", "clm", "reimbursement", "settlement"],
    "premium": ["premium", "payment", "txn", "transaction", "premium_amt"],
    "agent": ["agent", "agt", "advisor", "representative", "broker"],
    "hospital": ["hospital", "hosp", "facility", "clinic", "network_hospital"],
    "nominee": ["nominee", "nom", "beneficiary", "dependent", "family_member"],
    "sum_insured": ["sum_insured", "sum_assured", "coverage_amount", "si", "sa"],
    "policyholder": ["policyholder", "ph", "customer", "insured", "proposer"],
}

DATE_MARKERS = ["_dt", "_at", "_date", "date", "time"]
DATE_BASE_WORDS = ["created", "create", "updated", "update", "modified", "modify", "deleted", "delete"]

MERGE_PATTERNS = [
    (["first_name", "last_name"], "full_name", "{0} {1}"),
    (["fname", "lname"], "name", "{0} {1}"),
    (["street", "city", "state", "zip"], "address", "{0}, {1}, {2} {3}"),
    (["addr", "city", "state", "zip"], "full_address", "{0}, {1}, {2} {3}"),
    (["day", "month", "year"], "date", "{2}-{1}-{0}"),
    (["area_code", "phone"], "phone_number", "({0}) {1}"),
]
SPLIT_DELIMITERS = [" ", ",", ";", "|", "-", "_"]

# --- fixed values: types -------------------------------------------------------

TYPE_ALIASES = {
    "INT": "INTEGER", "INT4": "INTEGER", "INT8": "BIGINT", "SMALLINT": "SMALLINT",
    "TINYINT": "TINYINT", "BIGINT": "BIGINT", "SERIAL": "INTEGER", "BIGSERIAL": "BIGINT",
    "FLOAT": "FLOAT", "FLOAT4": "FLOAT", "FLOAT8": "DOUBLE", "DOUBLE": "DOUBLE",
    "DOUBLE PRECISION": "DOUBLE", "REAL": "REAL", "NUMERIC": "NUMERIC", "DECIMAL": "DECIMAL",
    "VARCHAR": "VARCHAR", "CHARACTER VARYING": "VARCHAR", "CHAR": "CHAR", "CHARACTER": "CHAR",
    "TEXT": "TEXT", "STRING": "TEXT", "NVARCHAR": "NVARCHAR", "NCHAR": "NCHAR", "CLOB": "TEXT",
    "BLOB": "BLOB", "BINARY": "BLOB", "VARBINARY": "BLOB", "BYTEA": "BLOB",
    "DATE": "DATE", "TIME": "TIME", "DATETIME": "DATETIME", "TIMESTAMP": "TIMESTAMP",
    "TIMESTAMP WITHOUT TIME ZONE": "TIMESTAMP", "TIMESTAMP WITH TIME ZONE": "TIMESTAMPTZ",
    "BOOLEAN": "BOOLEAN", "BOOL": "BOOLEAN", "BIT": "BOOLEAN",
    "JSON": "JSON", "JSONB": "JSON",
}

CONVERSION_RULES = [
    ("INTEGER", "INTEGER", "direct", "No conversion needed"),
    ("INTEGER", "BIGINT", "implicit", "Safe upcast to larger integer"),
    ("BIGINT", "INTEGER", "lossy", "May overflow if value > 2^31"),
    ("INTEGER", "FLOAT", "implicit", "Safe conversion to float"),
    ("INTEGER", "VARCHAR", "explicit", "Convert number to string"),
    ("INTEGER", "TEXT", "explicit", "Convert number to string"),
    ("FLOAT", "FLOAT", "direct", "No conversion needed"),
    ("FLOAT", "DOUBLE", "implicit", "Safe upcast to double"),
    ("DOUBLE", "FLOAT", "lossy", "May lose precision"),
    ("FLOAT", "INTEGER", "lossy", "Truncates decimal portion"),
    ("FLOAT", "VARCHAR", "explicit", "Convert number to string"),
    ("VARCHAR", "VARCHAR", "direct", "No conversion needed"),
    ("VARCHAR", "TEXT", "implicit", "Safe conversion to unlimited text"),
    ("TEXT", "VARCHAR", "lossy", "May truncate if too long"),
    ("CHAR", "VARCHAR", "implicit", "Safe conversion"),
    ("VARCHAR", "INTEGER", "explicit", "Parse string as integer"),
    ("VARCHAR", "FLOAT", "explicit", "Parse string as float"),
    ("DATE", "DATE", "direct", "No conversion needed"),
    ("DATE", "DATETIME", "implicit", "Add midnight time component"),
    ("DATE", "TIMESTAMP", "implicit", "Add midnight time component"),
    ("DATETIME", "DATE", "lossy", "Time component will be lost"),
    ("TIMESTAMP", "DATE", "lossy", "Time component will be lost"),
    ("DATETIME", "TIMESTAMP", "direct", "Same precision"),
    ("VARCHAR", "DATE", "explicit", "Parse string as date"),
    ("VARCHAR", "DATETIME", "explicit", "Parse string as datetime"),
    ("BOOLEAN", "BOOLEAN", "direct", "No conversion needed"),
    ("BOOLEAN", "INTEGER", "explicit", "Convert to 0/1"),
    ("INTEGER", "BOOLEAN", "explicit", "Non-zero = true"),
    ("VARCHAR", "BOOLEAN", "explicit", "Parse yes/no, true/false, 1/0"),
    ("JSON", "JSON", "direct", "No conversion needed"),
    ("JSON", "TEXT", "implicit", "Serialize to string"),
    ("TEXT", "JSON", "explicit", "Parse as JSON"),
]

TYPE_COMPATIBILITY = {
    "INTEGER": ["INTEGER", "BIGINT", "INT", "SMALLINT", "NUMERIC", "DECIMAL", "FLOAT", "DOUBLE", "REAL"],
    "INT": ["INTEGER", "BIGINT", "INT", "SMALLINT", "NUMERIC", "DECIMAL", "FLOAT", "DOUBLE", "REAL"],
    "BIGINT": ["BIGINT", "INTEGER", "NUMERIC", "DECIMAL"],
    "FLOAT": ["FLOAT", "DOUBLE", "REAL", "NUMERIC", "DECIMAL"],
    "DOUBLE": ["DOUBLE", "FLOAT", "REAL", "NUMERIC", "DECIMAL"],
    "REAL": ["REAL", "FLOAT", "DOUBLE", "NUMERIC", "DECIMAL"],
    "TEXT": ["TEXT", "VARCHAR", "CHAR", "NVARCHAR", "NCHAR", "STRING", "CLOB"],
    "VARCHAR": ["VARCHAR", "TEXT", "CHAR", "NVARCHAR", "NCHAR", "STRING"],
    "CHAR": ["CHAR", "VARCHAR", "TEXT", "NCHAR"],
    "BLOB": ["BLOB", "BINARY", "VARBINARY", "BYTEA"],
    "DATE": ["DATE", "DATETIME", "TIMESTAMP"],
    "DATETIME": ["DATETIME", "TIMESTAMP", "DATE"],
    "TIMESTAMP": ["TIMESTAMP", "DATETIME", "DATE"],
    "BOOLEAN": ["BOOLEAN", "BIT", "TINYINT", "INTEGER"],
    "BOOL": ["BOOLEAN", "BIT", "TINYINT", "INTEGER"],
}

# --- fixed values: plain-language texts -----------------------------------------

RULE_TEXTS = {
    "direct": ("No changes needed", "The data formats are identical."),
    "cast_int": ("Convert to whole number", "The new system expects whole numbers only."),
    "cast_float": ("Convert to decimal number", "The new system uses decimal numbers."),
    "cast_str": ("Convert to text", "The new system stores this as text."),
    "uppercase": ("Convert to UPPERCASE", "The new system requires uppercase text."),
    "lowercase": ("Convert to lowercase", "The new system requires lowercase text."),
    "trim": ("Remove extra spaces", "Extra spaces at the start/end will be removed."),
    "date_format": ("Change date format", "The date will be reformatted to match the new system."),
    "split": ("Split into multiple fields", "One field becomes multiple fields in the new system."),
    "merge": ("Combine multiple fields", "Multiple fields become one in the new system."),
}
RULE_TEXT_OTHER = ("Data conversion", "The data needs to be adjusted for the new system.")

REJECT_CAUSES = {
    "NOT NULL": (
        "Missing required data",
        "The new system requires this field to have a value, but the old record was empty.",
        "Fill in the missing data or update the new system to allow empty values.",
    ),
    "FOREIGN KEY": (
        "Related data not found",
        "This record references other data that doesn't exist in the new system yet.",
        "Ensure related records are migrated first, or remove the reference.",
    ),
    "UNIQUE": (
        "Duplicate entry",
        "A record with the same key already exists in the new system.",
        "Decide whether to skip, update, or merge this record.",
    ),
    "TYPE": (
        "Data format issue",
        "The data couldn't be converted to the format required by the new system.",
        "Review and fix the data format in the source, or adjust the conversion rules.",
    ),
}
REJECT_CAUSE_OTHER = (
    "Migration error",
    "An unexpected issue occurred while moving this record.",
    "Review the technical details and consult with your data team.",
)
