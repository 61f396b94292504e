"""These must keep exactly these spellings for results to agree."""

# Severity scale, lowest first.
SEVERITIES = ("informational", "low", "medium", "high", "critical")

# Change-journal reasons that can hide or remove traces.
ANTI_FORENSIC_REASONS = (
    "FileDelete",
    "RenameNewName",
    "RenameOldName",
    "DataOverwrite",
    "NamedDataOverwrite",
)

# Registry plugins that report persistence or execution residue.
PERSISTENCE_PLUGINS = (
    "RunKeys",
    "RunOnce",
    "Services",
    "TaskCache",
    "UserAssist",
    "ShimCache",
    "AppCompatCache",
    "BAM",
    "WinlogonShellRunOnce",
)

# Technique ids of lateral movement and credential access.
LATERAL_TECHNIQUES = (
    "T1003.001",
    "T1003.002",
    "T1003.003",
    "T1021.001",
    "T1021.002",
    "T1021.006",
    "T1078",
    "T1078.002",
    "T1110",
    "T1550.001",
    "T1550.002",
    "T1550.003",
    "T1558.003",
    "T1570",
    "T1070.001",
    "T1070.002",
    "T1070.006",
    "T1053.005",
    "T1547.001",
)

# Memory plugins whose rows have a helper of their own.
PROCESS_PLUGINS = ("windows.pslist.PsList",)
SECRET_PLUGINS = ("windows.lsadump.Lsadump", "windows.lsadump.Cachedump")
HANDLE_PLUGINS = ("windows.handles.Handles",)

# Credential artifact classes.
CREDENTIAL_CLASSES = (
    "registry_hive",
    "dpapi_master_key",
    "browser_credential_db",
    "lsass_dump",
    "hibernation_file",
    "pagefile",
    "kernel_crash_dump",
    "ntds_dit",
    "ssh_private_key",
    "ssh_known_hosts",
    "ssh_host_key",
)

# Closed list of finding types.
FINDING_TYPES = (
    "T1550.002_pass_the_hash_candidate",
    "T1550.003_pass_the_ticket_candidate",
    "T1558.003_kerberoasting_candidate",
    "T1550.002_overpass_the_hash_candidate",
    "T1547.001_registry_run_key",
    "T1053.005_scheduled_task",
    "T1053.005_hidden_scheduled_task_tarrask",
    "T1070.001_log_clearing",
    "T1070.006_timestomp_candidate",
    "T1070.001_evtx_recordid_gap",
    "T1003.001_lsass_dump_candidate",
    "T1003.002_sam_dump_candidate",
    "execution_residue_suspicious",
    "narrative_inference",
)

# Verdicts of a claim.
VERIFIED, QUARANTINED, DRIFT = "verified", "quarantined", "drift"

# Answer types of a question.
ANSWER_TYPES = (
    "exact_string",
    "string_ci",
    "hex_hash",
    "numeric",
    "timestamp",
    "path",
    "sid",
    "list_of_strings",
    "nss_inode_filename_list",
)
LIST_ANSWER_TYPES = ("list_of_strings", "nss_inode_filename_list")

# Default encodings of a literal search.
SEARCH_ENCODINGS = ("ascii", "utf-8", "utf-16-le", "utf-16-be")

# Tools for which a hypothesis can be proposed: finding type, tool, base predicate.
HYPOTHESES = (
    ("T1550.002_pass_the_hash_candidate", "parse_evtx", {"event_id": "4624"}),
    ("T1003.001_lsass_dump_candidate", "parse_amcache", {}),
    ("T1070.001_log_clearing", "run_hayabusa", {}),
    ("T1070.006_timestomp_candidate", "parse_mft", {}),
    ("T1547.001_registry_run_key", "parse_registry", {}),
    ("T1053.005_scheduled_task", "parse_evtx", {"event_id": "4698"}),
)

# Fields that identify a record, in order of preference.
IDENTIFIER_FIELDS = (
    "event_record_id",
    "record_number",
    "entry_number",
    "usn",
    "sha1",
    "name",
    "rule_title",
    "key_path",
    "value_name",
    "plugin",
)

# Store folders that never hold receipts.
RESERVED_FOLDERS = ("envelopes", "handles", "benchmarks", "receipts")
CANONICAL_FOLDER = "envelopes"

# Filesystem words of a question, first hit wins.
FILESYSTEM_WORDS = (
    "first windows data",
    "second windows data",
    "third windows data",
    "linux",
    "hfs",
    "exfat",
    "ntfs",
    "fat",
)

# Quoted strings in a question that are format examples, not search text.
FORMAT_EXAMPLES = (
    "inode:filename",
    "inode:filename, ...",
    "DELETED-test-email.txt",
    "LIVE-test-email.txt",
    "count",
)
