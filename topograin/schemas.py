"""Schemas of the tables that operators exchange."""

from __future__ import annotations

from .functions.tokens import TOKEN

KB_COUNTS = "mention string, qid string, n long"
KB_NORM = "mention string, qid string, relv double"
GAZETTEER = "qid string, label string, lat double, lon double"
ENTITY_CLASS = "qid string, class_qid string"
EMBEDDINGS = "word string, emb array<float>"
TITLES = "wikipedia_title string, lower_wikipedia_title string, wikidata_id string"
SENTENCES = "doc_id string, sent_idx int, sentence string"
TAGGED = f"doc_id string, sent_idx int, sentence string, tokens array<{TOKEN}>"
MENTIONS = "doc_id string, sent_idx int, mention string, tag string, pos int, end_pos int, start_offset int, end_offset int, ner_score double, entity_link string"
CANDIDATES = "mention string, variation string, score double, qid string, relv double, n long"
RESOLVED = "doc_id string, sent_idx int, mention string, pos int, end_pos int, tag string, ner_score double, prediction string, ed_score double, lat double, lon double, wkdt_class string"
ARTICLE = "article_id string, sentences array<struct<sentence_pos:int,sentence_text:string>>, annotations array<struct<mention_pos:int,mention:string,entity_type:string,wkpd_url:string,wkdt_qid:string,mention_start:int,mention_end:int,sent_pos:int>>, place string, decade int, year int, ocr_quality_mean double, ocr_quality_sd double, publication_title string, publication_code string, place_wqid string"
NER_ROW = "id string, ner_tags array<string>, tokens array<string>"
PUBLICATION = "code string, publication_title string, publication_place string, publication_ctxt string, publication_dates string, wikidata_qid string"
STRING_PAIR = "s1 string, s2 string, label boolean"
