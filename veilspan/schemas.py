"""Explicit schemas of the tables and nested columns the operators exchange."""

SPAN_FIELDS = [
    ("start", "int"), ("end", "int"), ("text", "string"), ("label", "string"), ("label_adjusted", "string"),
    ("subtype", "string"), ("score", "double"), ("source", "string"), ("keyword", "string"),
]
SPAN = "struct<" + ",".join(f"{n}:{t}" for n, t in SPAN_FIELDS) + ">"
SPANS = f"array<{SPAN}>"

RULES = ("struct<mode:string,simple_rule:string,label_rules:map<string,string>,"
         "entity_rules:map<string,string>,default:string>")
RECORD = ("struct<entity_id:string,original_text:string,masked_text:string,label:string,subtype:string,"
          "start:int,end:int,metadata:struct<source:string,confidence:double>>")
VAULT = ("session_id string, timestamp string, original_text string, masked_text string, "
         f"masking_rules {RULES}, records array<{RECORD}>, "
         "stats struct<total_masked:int,text_length:int,masked_length:int>")

TRANSCRIPT = (
    "timestamp string, original_audio string, "
    "audio_improvement struct<noise_reduction:double,clarity:double,overall:double>, "
    "stt_stats struct<total_chunks:int,success_chunks:int,failed_chunks:int,retry_count:int,"
    "total_duration:double,success_rate:double,processing_time:double>, "
    "processing_time double, sentences array<struct<text:string,start_time:double,end_time:double>>")

_METRICS = "struct<rms:string,rms_db:string,dynamic_range:string,spectral_centroid:double,zcr:double>"
RUN = (
    "session_id string, timestamp string, "
    f"audio_enhancement struct<before:{_METRICS},after:{_METRICS},"
    "improvement:struct<noise_reduction:double,snr_improvement:double,dynamic_range:double,overall:double>>, "
    "speech_to_text struct<success:boolean,text:string,chunks:array<struct<chunk_index:int,text:string,"
    "success:boolean,error:string,duration:double>>,total_chunks:int,success_chunks:int,"
    "duration_seconds:double,error:string>, "
    "text_correction struct<corrected_text:string,suspicious_parts:int,auto_corrections:array<struct<"
    "type:string,original:string,corrected:string,confidence:double,position:int>>,needs_review:boolean>, "
    f"pii_detection struct<total_entities:int,entities:{SPANS}>, "
    "masking struct<masked_text:string,total_masked:int,mapping_file:string>, "
    "processing_time map<string,double>, errors array<string>")

NER_RESPONSE = ("struct<sentence:array<struct<id:string,text:string,morp:array<struct<id:int,lemma:string>>,"
                "NE:array<struct<type:string,text:string,begin:int,end:int>>>>>")
ASR_RESPONSE = ("struct<result:int,reason:string,return_object:struct<recognized:string,result:string,text:string>>")
VERDICT_RESPONSE = (
    "struct<decisions:array<struct<id:string,keep:string,label:string,subtype:string,reason:string,confidence:string>>,"
    "additions:array<struct<win_id:string,start_rel:string,end_rel:string,label:string,subtype:string,"
    "reason:string,confidence:string>>>")
CORRECTION_RESPONSE = (
    "struct<corrected_text:string,"
    "auto_corrections:array<struct<type:string,original:string,corrected:string,confidence:double,position:int>>,"
    "suspicious_parts:array<struct<text:string,start_char:int,end_char:int,confidence:double,reason:string,"
    "linguistic_type:string,suggestions:array<string>>>>")
ANALYSIS_RESPONSE = ("struct<topic:string,context_type:string,"
                     "semantic_issues:array<struct<text:string,suggested_correction:string>>>")
