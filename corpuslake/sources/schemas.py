"""Schemas of the stored tables."""

ACT_METADATA = (
    "act_number string, act_type string, scraped_at string, detail_url string, "
    "timeline array<struct<date:string,project_id:string,log_type:string,pdf_url:string>>, latest_reprint_pdf string, latest_amendment_pdf string, "
    "subsidiary_legislation array<struct<publication_date:string,pu_number:string,title_en:string,title_bm:string,status:string,related_legislation:string,pdf_url:string>>, "
    "subsidiary_total int, stub boolean"
)
RUN = "extraction_id:string,document_id:string,extractor:string,extractor_version:string,configuration_hash:string,chunk_set_hash:string,chunk_count:int,status:string"
CHUNK = "act_number:string,act_title:string,section_number:string,content:string,content_sha256:string,page_number:int,page_start:int,page_end:int,language:string,document_id:string,extraction_id:string"
BUNDLE = f"document struct<document_id:string,act_number:string,language:string,sha256:string>, extraction struct<{RUN}>, chunks array<struct<{CHUNK}>>"
#: The inner list mixes numbers and text, so it is read as text and cast.
WORDS = "document_id string, document_sha256 string, pages array<struct<page_number:int,width:double,height:double,words:array<array<string>>>>"
#: Fields of the five kinds of listing and the columns that they become.
LISTINGS = {
    "updated": {"act_number": "lgt_act_no", "title": "title"},
    "revised": {"act_number": "lgt_act_id", "title": "title", "revision_date": "lgt_timeline_date"},
    "repealed": {"act_number": "ILA_ACT_NO", "title_bm": "TITLEBM", "title_en": "TITLEBI", "repealed_by": "REPEALEDBY"},
    "amendment": {
        "act_number": "ACTNO_LEGISLATION",
        "title_bm": "TajukBM",
        "title_en": "TajukBI",
        "publication_date": "PUBLICATIONDATE",
        "royal_assent_date": "ROYALASSENTDATE",
        "commencement_date_en": "COMMENCEMENTDATEBI",
        "commencement_remark": "COMMENCEMENTREMARKBI",
        "project_id": "ILP_PROJECT_ID",
        "pdf_url_en": "URLDOCBI",
        "pdf_url_bm": "URLDOCBM",
    },
    "translated": {"act_number": "lgt_act_id", "title_bm": "titlebm", "title_en": "titlebi", "authoritative_language": "languageNaskhahSahih"},
}
