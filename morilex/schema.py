"""Schemas of the engine's tables of analysed text."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


S, L, I, D, B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
HOMOGRAPH = _struct(midasi=S, genkei=S, hinsi=S, bunrui=S, katuyou1=S, katuyou2=S, repname=S, imis=S)
MORPHEMES = _struct(doc_id=S, sent_id=I, pos=I, bnst_idx=I, mrph_idx=I, midasi=S, yomi=S, genkei=S, hinsi=S, bunrui=S, katuyou1=S, katuyou2=S, imis=S, fstring=S, repname=S, doukei=T.ArrayType(HOMOGRAPH))
BUNSETSU = _struct(doc_id=S, sent_id=I, bnst_idx=I, fstring=S, parent_idx=I, dpndtype=S)
EXAMPLES = _struct(example_id=L, seq=L, pivot=S, type=S, front_string=S, front_list=T.ArrayType(_struct(pos=I, str=S, tag=S)), rear_string=S, rear_cands=T.MapType(S, _struct(bare=S, pos=T.MapType(S, _struct(katuyou2=S, suffix=S)))))
ENTRY = _struct(hinsi=S, bunrui=S, katuyou1=S, yomi=S, midasi=T.MapType(S, D), imis=T.MapType(S, S), annotation=T.MapType(S, S))
SUFFIXES = _struct(suffix=S, len=I, pos_s=S, katuyou2=S, cnt=L)
FEATURES = _struct(doc_id=S, domain=S, name=S, acquired=B, classes=T.ArrayType(I), ftype=S, fname=S)
INSTANCES = _struct(name=S, is_ng=B, classes=T.ArrayType(I), origin=S, feats=T.MapType(I, L))
WEIGHTS = _struct(class_id=I, fid=I, weight=D)
