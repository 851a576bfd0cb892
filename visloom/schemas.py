"""Record shapes. Image bytes stay in files; rows carry only the reference."""

from __future__ import annotations

IMAGE = "struct<path:string,width:int,height:int,filename:string>"
BOX = "struct<x1:double,y1:double,x2:double,y2:double>"
CONTENT = f"struct<type:string,image:{IMAGE},text:string>"
MESSAGE = f"struct<role:string,content:array<{CONTENT}>>"
IMAGE_INFO = "struct<slot:string,origin_slot:string,width:int,height:int,filename:string>"

PAIR_RAW = (
    "uid string, identifier string, id string, sentence string, label string, "
    f"image struct<left:{IMAGE},right:{IMAGE}>, image0 {IMAGE}, image1 {IMAGE}"
)
GUI_RAW = (
    f"images array<{IMAGE}>, texts array<struct<system:string,user:string,assistant:string>>, "
    "source string, dataset string, config string, split string"
)
GROUNDING_RAW = (
    f"image {IMAGE}, bbox array<double>, instruction string, data_type string, "
    "data_source string, split string"
)
TOKEN_SCORES = "sample_id string, pos int, token_id bigint, logprob double"
MODULES = "name string, kind string, in_features bigint, out_features bigint"

# The configuration names the two GUI sets publish.
STAGE1_CONFIGS = [
    "guienv",
    "omniact",
    "ricoig16k",
    "ricosca",
    "seeclick",
    "ui_refexp",
    "webui350k",
    "widget_captioning",
]
STAGE2_CONFIGS = [
    "aitw-l1",
    "aitw-l2",
    "aitw-l3",
    "amex-l1",
    "amex-l2",
    "amex-l3",
    "android_control",
    "coat",
    "gui-odyssey-l1",
    "gui-odyssey-l2",
    "gui-odyssey-l3",
    "guiact-web-multi-l1",
    "guiact-web-multi-l2",
    "guiact-web-multi-l3",
    "guiact-web-single",
    "mind2web-l1",
    "mind2web-l2",
    "mind2web-l3",
    "miniwob-l1",
    "miniwob-l2",
    "miniwob-l3",
]
CONFIGS = {"stage1": STAGE1_CONFIGS, "stage2": STAGE2_CONFIGS}
