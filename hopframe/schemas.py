"""Explicit schemas of the raw files and of the engine's own tables."""

from __future__ import annotations

# As stored on disk: mixed arrays are read as arrays of text and typed afterwards.
RAW_WIKI = (
    "_id string, question string, answer string, type string, entity_ids string, "
    "supporting_facts array<array<string>>, context array<array<string>>, "
    "evidences array<array<string>>"
)
RAW_HOTPOT = (
    "_id string, question string, answer string, type string, level string, "
    "supporting_facts array<array<string>>, context array<array<string>>"
)
RAW_CELEBRITIES = (
    "data array<struct<Question:string,Answer:array<string>,"
    "Q1:string,A1:array<string>,Q2:string,A2:array<string>>>"
)
RAW_STRATEGY = (
    "qid string, term string, description string, question string, answer string, "
    "facts array<string>, decomposition array<string>"
)
RAW_INSTANCES = "Instances array<struct<input:string,output:array<string>>>"
RAW_QUARTZ = (
    "id string, answerKey string, para string, para_id string, "
    "question struct<stem:string,choices:array<struct<label:string,text:string>>>"
)
RAW_PASSAGES = (
    "title string, text string, links array<struct<indices:array<long>,target:string>>, "
    "questions array<struct<question:string,answer:struct<type:string,answer_value:string,"
    "answer_unit:string>,question_links:array<string>,context:array<struct<text:string,"
    "passage:string,indices:array<long>>>>>"
)

# Typed forms.
FACT_REF = "struct<title:string,sent_id:int>"
PARAGRAPH = "struct<title:string,sentences:array<string>>"
TRIPLE = "struct<subject:string,relation:string,object:string>"

EXAMPLE = (
    "id string, prompt string, target string, answer string, num_prompt_tokens int, "
    "num_target_tokens int, num_tokens int, hops int, type string, relationships array<string>"
)
RESPONSE = "run_id string, id string, pos long, response string, answer string, self_ask boolean"
MACRO_FILE = (
    "model string, strategy string, answer_first boolean, random_facts boolean, examplars boolean, "
    "macro_results struct<accuracy:double,`F1-1`:double,`F1-2`:double,`bleu-1`:double,"
    "`bleu-2`:double,`rouge-1`:double,`rouge-2`:double,`rouge-L`:double>"
)
MICRO_FILE = (
    "micro_results struct<correct:array<boolean>,`bleu-1`:array<double>,`bleu-2`:array<double>,"
    "`rouge-1`:array<double>,`rouge-2`:array<double>,`rouge-L`:array<double>,"
    "`F1-1`:array<double>,`F1-2`:array<double>>"
)

# Score columns of the engine beside their names in result documents.
METRICS = {
    "bleu_1": "bleu-1",
    "bleu_2": "bleu-2",
    "rouge_1": "rouge-1",
    "rouge_2": "rouge-2",
    "rouge_l": "rouge-L",
    "f1_1": "F1-1",
    "f1_2": "F1-2",
}
