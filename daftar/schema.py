"""Table layouts as DDL strings, and the closed value sets that go with them."""

DOCUMENT = (
    "document_id string, filename string, original_filename string, file_path string, mime_type string,"
    " file_size long, extraction_mode string, total_pages int, title string, detected_grade_name string,"
    " detected_subject_name string, language string, metadata map<string,string>,"
    " created_at timestamp, updated_at timestamp"
)
PAGE = (
    "document_id string, page_number int, text string, extracted_text_length int,"
    " low_text boolean, ocr_detected boolean"
)
CLASSIFICATION = (
    "document_id string, grade_name string, subject_name string, title string, language string,"
    " quality_notes array<string>"
)
CHUNK_DRAFT = (
    "document_id string, chunk_index int, content string, original_content string, page_start int,"
    " page_end int, title string, language string, segment_type string, ocr_detected boolean,"
    " metadata map<string,string>"
)
CHUNK = (
    "chunk_id string, " + CHUNK_DRAFT + ", quality_score double, repair_status string, is_active boolean,"
    " is_duplicate boolean, duplicate_of string, content_hash string, embedding array<float>,"
    " embedding_status string, embedding_model string, embedding_claimed_at timestamp,"
    " source_type string, source_id string, grade_id string, cycle_id string, curriculum_id string,"
    " subject_id string, topic_id string, chunk_size int, is_processed boolean, qa_generated boolean,"
    " processed_at timestamp, created_at timestamp, updated_at timestamp"
)
CHUNK_VERSION = (
    "chunk_id string, version_index int, content string, content_hash string,"
    " metadata map<string,string>, created_at timestamp"
)
EMBEDDING = (
    "chunk_id string, embedding array<float>, model string, is_active boolean,"
    " metadata map<string,string>, created_at timestamp, updated_at timestamp"
)
RETRIEVAL_TEST = (
    "chunk_id string, query_text string, retrieved_chunk_ids array<string>,"
    " retrieved_scores array<double>, passed boolean, metadata map<string,string>, created_at timestamp"
)
JOB = (
    "job_id string, document_id string, status string,"
    " logs array<struct<message:string,level:string,at:timestamp>>, error_message string,"
    " retry_count int, started_at timestamp, completed_at timestamp,"
    " created_at timestamp, updated_at timestamp"
)
QUESTION = (
    "chunk_id string, grade_id string, question string, answer string,"
    " question_embedding array<float>, model_used string, created_at timestamp"
)
SCRAPER_SOURCE = "source_id string, url string, url_hash string, last_scraped_at timestamp"
CANDIDATE = (
    "candidate_id string, source_id string, source_url string, pdf_url string, url_hash string,"
    " filename string, detected_title string, detected_grade string, status string,"
    " created_at timestamp, updated_at timestamp"
)

# The closed status sets.
REPAIR_STATUS = [
    "clean", "needs_review", "auto_repaired", "rejected", "embedded", "embedding_failed", "duplicate",
]
EMBEDDING_STATUS = ["pending", "processing", "done", "failed"]
JOB_STATUS = [
    "pending", "extracting", "ocr_running", "chunking", "quality_scan", "repairing", "embedding",
    "completed", "failed",
]
CANDIDATE_STATUS = ["discovered", "approved", "rejected", "downloaded", "queued", "failed"]
EMBEDDABLE_STATUS = ["clean", "embedded", "auto_repaired"]

# Grades in the order work on them is taken up.
GRADE_ORDER = [
    "2ème année Bac", "1ère année Bac", "Tronc Commun",
    "3ème année collège", "2ème année collège", "1ère année collège",
    "6ème année primaire", "5ème année primaire", "4ème année primaire",
    "3ème année primaire", "2ème année primaire", "1ère année primaire",
]
