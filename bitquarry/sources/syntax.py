"""Syntax tables of parameter sets, messages and slice headers, and the interpreter that reads them.

A table is text: a line ``name descriptor`` reads a field, ``name[count] descriptor`` a list, ``name = table(...)`` or
``name[count] = table(...)`` another table, ``let`` and ``set`` compute a value (``set`` keeps it as a field),
``if``/``elif``/``else`` and indentation make fields conditional, ``check`` rejects, ``trailing`` and ``align`` read
the closing bits, ``data`` reads flags up to the closing bits. Conditions are Python expressions over the fields
read so far. Fields that weren't read are absent, which is not the same as zero.
"""

from __future__ import annotations

import re
from collections import ChainMap
from functools import lru_cache
from typing import Any

from .bits import BitReader, BitstreamError

#: Entries that a list may have; counts come from the data and must not decide how much memory is asked for.
MOST = 1 << 16

TABLES = """
table profile_info()
  profile_space u(2)
  tier_flag flag
  profile_idc u(5)
  compatibility_flags[32] flag
  progressive_source_flag flag
  interlaced_source_flag flag
  non_packed_constraint_flag flag
  frame_only_constraint_flag flag
  let begin = position()
  let named = {profile_idc} | raised(compatibility_flags)
  if named & set(range(4, 12))
    max_12bit_constraint_flag flag
    max_10bit_constraint_flag flag
    max_8bit_constraint_flag flag
    max_422chroma_constraint_flag flag
    max_420chroma_constraint_flag flag
    max_monochrome_constraint_flag flag
    intra_constraint_flag flag
    one_picture_only_constraint_flag flag
    lower_bit_rate_constraint_flag flag
    if named & {5, 9, 10, 11}
      max_14bit_constraint_flag flag
      reserved_zero_bits u(33)
    else
      reserved_zero_bits u(34)
  elif 2 in named
    set reserved_zero_bits = ahead(43)
    let _ = skip(7)
    one_picture_only_constraint_flag flag
    let _ = skip(35)
  else
    reserved_zero_bits u(43)
  if named & {1, 2, 3, 4, 5, 9, 11}
    inbld_flag flag
  else
    let _ = skip(1)
  set constraint_flags = since(begin)

table sub_layer_profile(profile_present, level_present)
  set profile_present_flag = profile_present
  set level_present_flag = level_present
  if profile_present
    profile = profile_info()
  if level_present
    level_idc u(8)

table presence()
  profile flag
  level flag

table profile_tier_level(profile_present_flag, max_sub_layers_minus1)
  check max_sub_layers_minus1 <= 7 : maxNumSubLayersMinus1 must be at most 7
  if profile_present_flag
    general_profile = profile_info()
  general_level_idc u(8)
  hidden[max_sub_layers_minus1] = presence()
  if max_sub_layers_minus1 > 0
    reserved_zero_2bits[8 - max_sub_layers_minus1] u(2)
  sub_layers[max_sub_layers_minus1] = sub_layer_profile(hidden[index]['profile'], hidden[index]['level'])

table ordering_info()
  max_dec_pic_buffering_minus1 ue
  max_num_reorder_pics ue
  max_latency_increase_plus1 ue

table layer_set(max_layer_id)
  included[max_layer_id + 1] flag

table cpb(sub_pic)
  bit_rate_value_minus1 ue
  cpb_size_value_minus1 ue
  if sub_pic
    cpb_size_du_value_minus1 ue
    bit_rate_du_value_minus1 ue
  cbr_flag flag

table hrd_sub_layer(nal, vcl, sub_pic)
  fixed_pic_rate_general_flag flag
  set fixed_pic_rate_within_cvs_flag = True
  if not fixed_pic_rate_general_flag
    fixed_pic_rate_within_cvs_flag flag
  set low_delay_hrd_flag = False
  if fixed_pic_rate_within_cvs_flag
    elemental_duration_in_tc_minus1 ue
  else
    low_delay_hrd_flag flag
  let count = 0
  if not low_delay_hrd_flag
    cpb_cnt_minus1 ue
    let count = cpb_cnt_minus1 + 1
  if nal
    nal_hrd_parameters[count] = cpb(sub_pic)
  if vcl
    vcl_hrd_parameters[count] = cpb(sub_pic)

table hrd(common, max_sub_layers_minus1)
  check max_sub_layers_minus1 <= 6 : maxNumSubLayersMinus1 must be at most 6
  set nal_hrd_parameters_present_flag = False
  set vcl_hrd_parameters_present_flag = False
  set sub_pic_hrd_params_present_flag = False
  if common
    nal_hrd_parameters_present_flag flag
    vcl_hrd_parameters_present_flag flag
  if nal_hrd_parameters_present_flag or vcl_hrd_parameters_present_flag
    sub_pic_hrd_params_present_flag flag
    if sub_pic_hrd_params_present_flag
      tick_divisor_minus2 u(8)
      du_cpb_removal_delay_increment_length_minus1 u(5)
      sub_pic_cpb_params_in_pic_timing_sei_flag flag
      dpb_output_delay_du_length_minus1 u(5)
    bit_rate_scale u(4)
    cpb_size_scale u(4)
    if sub_pic_hrd_params_present_flag
      cpb_size_du_scale u(4)
    initial_cpb_removal_delay_length_minus1 u(5)
    au_cpb_removal_delay_length_minus1 u(5)
    dpb_output_delay_length_minus1 u(5)
  sub_layers[max_sub_layers_minus1 + 1] = hrd_sub_layer(nal_hrd_parameters_present_flag, vcl_hrd_parameters_present_flag, sub_pic_hrd_params_present_flag)

table vps_hrd(index_, max_sub_layers_minus1)
  hrd_layer_set_idx ue
  set cprms_present_flag = True
  if index_ > 0
    cprms_present_flag flag
  hrd_parameters = hrd(cprms_present_flag, max_sub_layers_minus1)

table timing(kind, max_sub_layers_minus1)
  num_units_in_tick u(32)
  time_scale u(32)
  poc_proportional_to_timing_flag flag
  if poc_proportional_to_timing_flag
    num_ticks_poc_diff_one_minus1 ue
  if kind == 'vps'
    num_hrd_parameters ue
    hrd[num_hrd_parameters] = vps_hrd(index, max_sub_layers_minus1)
  else
    hrd_parameters_present_flag flag
    if hrd_parameters_present_flag
      hrd_parameters = hrd(True, max_sub_layers_minus1)

table vps()
  vps_video_parameter_set_id u(4)
  vps_base_layer_internal_flag flag
  vps_base_layer_available_flag flag
  vps_max_layers_minus1 u(6)
  vps_max_sub_layers_minus1 u(3)
  vps_temporal_id_nesting_flag flag
  vps_reserved_0xffff_16bits u(16)
  profile_tier_level = profile_tier_level(True, vps_max_sub_layers_minus1)
  vps_sub_layer_ordering_info_present_flag flag
  sub_layer_ordering_info[vps_max_sub_layers_minus1 + 1 if vps_sub_layer_ordering_info_present_flag else 1] = ordering_info()
  vps_max_layer_id u(6)
  vps_num_layer_sets_minus1 ue
  layer_id_included_flag[vps_num_layer_sets_minus1] = layer_set(vps_max_layer_id)
  vps_timing_info_present_flag flag
  if vps_timing_info_present_flag
    timing = timing('vps', vps_max_sub_layers_minus1)
  vps_extension_flag flag
  if vps_extension_flag
    extension_data data
  trailing

table scaling_matrix(size_id_, matrix_id_)
  set size_id = size_id_
  set matrix_id = matrix_id_
  pred_mode_flag flag
  if not pred_mode_flag
    pred_matrix_id_delta ue
  else
    let first = 8
    if size_id > 1
      dc_coef_minus8 se
      let first = dc_coef_minus8 + 8
    delta_coefficients[min(64, 16 << 2 * size_id)] se
    set coefficients = running(first, delta_coefficients)

table scaling_list_data()
  matrices[20] = scaling_matrix(min(index // 6, 3), index % 6 if index < 18 else (index - 18) * 3)

table st_ref_pic_set(idx, previous, number)
  set index = idx
  set inter_ref_pic_set_prediction_flag = False
  if idx != 0
    inter_ref_pic_set_prediction_flag flag
  if inter_ref_pic_set_prediction_flag
    let back = 1
    if idx == number
      delta_idx_minus1 ue
      let back = delta_idx_minus1 + 1
    check idx >= back and idx - back < len(previous) : referenced short-term RPS index is out of range
    set reference_rps_idx = idx - back
    delta_rps_sign flag
    abs_delta_rps_minus1 ue
    entries[previous[reference_rps_idx]['num_delta_pocs'] + 1] = st_predicted()
    set used_by_curr_pic_flag = [e['used'] for e in entries]
    set use_delta_flag = [e.get('use_delta', False) for e in entries]
    set num_delta_pocs = sum(a or b for a, b in zip(used_by_curr_pic_flag, use_delta_flag))
  else
    num_negative_pics ue
    num_positive_pics ue
    s0[num_negative_pics] = st_entry()
    s1[num_positive_pics] = st_entry()
    set num_delta_pocs = num_negative_pics + num_positive_pics

table st_predicted()
  used flag
  if not used
    use_delta flag

table st_entry()
  delta_poc_minus1 ue
  used flag

table lt_sps_entry(bits)
  poc_lsb_sps u(bits)
  used_by_curr_pic_lt_sps_flag flag

table pcm()
  sample_bit_depth_luma_minus1 u(4)
  sample_bit_depth_chroma_minus1 u(4)
  log2_min_pcm_luma_coding_block_size_minus3 ue
  log2_diff_max_min_pcm_luma_coding_block_size ue
  loop_filter_disabled_flag flag

table vui(max_sub_layers_minus1)
  aspect_ratio_info_present_flag flag
  if aspect_ratio_info_present_flag
    aspect_ratio_idc u(8)
    if aspect_ratio_idc == 255
      sar_width u(16)
      sar_height u(16)
  overscan_info_present_flag flag
  if overscan_info_present_flag
    overscan_appropriate_flag flag
  video_signal_type_present_flag flag
  set colour_description_present_flag = False
  if video_signal_type_present_flag
    video_format u(3)
    video_full_range_flag flag
    colour_description_present_flag flag
    if colour_description_present_flag
      colour_primaries u(8)
      transfer_characteristics u(8)
      matrix_coeffs u(8)
  chroma_loc_info_present_flag flag
  if chroma_loc_info_present_flag
    chroma_sample_loc_type_top_field ue
    chroma_sample_loc_type_bottom_field ue
  neutral_chroma_indication_flag flag
  field_seq_flag flag
  frame_field_info_present_flag flag
  default_display_window_flag flag
  if default_display_window_flag
    default_display_window[4] ue
  vui_timing_info_present_flag flag
  if vui_timing_info_present_flag
    timing_info = timing('vui', max_sub_layers_minus1)
  bitstream_restriction_flag flag
  if bitstream_restriction_flag
    tiles_fixed_structure_flag flag
    motion_vectors_over_pic_boundaries_flag flag
    restricted_ref_pic_lists_flag flag
    min_spatial_segmentation_idc ue
    max_bytes_per_pic_denom ue
    max_bits_per_min_cu_denom ue
    log2_max_mv_length_horizontal ue
    log2_max_mv_length_vertical ue

table sps()
  sps_video_parameter_set_id u(4)
  sps_max_sub_layers_minus1 u(3)
  sps_temporal_id_nesting_flag flag
  profile_tier_level = profile_tier_level(True, sps_max_sub_layers_minus1)
  sps_seq_parameter_set_id ue
  chroma_format_idc ue
  set separate_colour_plane_flag = False
  if chroma_format_idc == 3
    separate_colour_plane_flag flag
  pic_width_in_luma_samples ue
  pic_height_in_luma_samples ue
  conformance_window_flag flag
  if conformance_window_flag
    conformance_window[4] ue
  bit_depth_luma_minus8 ue
  bit_depth_chroma_minus8 ue
  log2_max_pic_order_cnt_lsb_minus4 ue
  sps_sub_layer_ordering_info_present_flag flag
  sub_layer_ordering_info[sps_max_sub_layers_minus1 + 1 if sps_sub_layer_ordering_info_present_flag else 1] = ordering_info()
  log2_min_luma_coding_block_size_minus3 ue
  log2_diff_max_min_luma_coding_block_size ue
  log2_min_luma_transform_block_size_minus2 ue
  log2_diff_max_min_luma_transform_block_size ue
  max_transform_hierarchy_depth_inter ue
  max_transform_hierarchy_depth_intra ue
  scaling_list_enabled_flag flag
  set sps_scaling_list_data_present_flag = False
  if scaling_list_enabled_flag
    sps_scaling_list_data_present_flag flag
  if sps_scaling_list_data_present_flag
    scaling_list_data = scaling_list_data()
  amp_enabled_flag flag
  sample_adaptive_offset_enabled_flag flag
  pcm_enabled_flag flag
  if pcm_enabled_flag
    pcm = pcm()
  num_short_term_ref_pic_sets ue
  short_term_ref_pic_sets[num_short_term_ref_pic_sets] = st_ref_pic_set(index, short_term_ref_pic_sets, num_short_term_ref_pic_sets)
  long_term_ref_pics_present_flag flag
  if long_term_ref_pics_present_flag
    num_long_term_ref_pics_sps ue
    check log2_max_pic_order_cnt_lsb_minus4 <= 60 : POC LSB bit width must be at most 64
    long_term_ref_pic_set[num_long_term_ref_pics_sps] = lt_sps_entry(log2_max_pic_order_cnt_lsb_minus4 + 4)
  sps_temporal_mvp_enabled_flag flag
  strong_intra_smoothing_enabled_flag flag
  vui_parameters_present_flag flag
  if vui_parameters_present_flag
    vui_parameters = vui(sps_max_sub_layers_minus1)
  sps_extension_present_flag flag
  if sps_extension_present_flag
    sps_extension = sps_extension(chroma_format_idc, bit_depth_luma_minus8, bit_depth_chroma_minus8)
  else
    trailing

table sps_extension(chroma, luma_minus8, chroma_minus8)
  sps_range_extension_flag flag
  sps_multilayer_extension_flag flag
  sps_3d_extension_flag flag
  sps_scc_extension_flag flag
  sps_extension_4bits u(4)
  if sps_range_extension_flag
    range_extension = sps_range()
  if sps_multilayer_extension_flag
    inter_view_mv_vert_constraint_flag flag
  if sps_3d_extension_flag
    three_d_extension = sps_3d()
  if sps_scc_extension_flag
    scc_extension = sps_scc(chroma, luma_minus8, chroma_minus8)
  if sps_extension_4bits != 0
    extension_data data
  trailing

table sps_range()
  transform_skip_rotation_enabled_flag flag
  transform_skip_context_enabled_flag flag
  implicit_rdpcm_enabled_flag flag
  explicit_rdpcm_enabled_flag flag
  extended_precision_processing_flag flag
  intra_smoothing_disabled_flag flag
  high_precision_offsets_enabled_flag flag
  persistent_rice_adaptation_enabled_flag flag
  cabac_bypass_alignment_enabled_flag flag

table sps_3d()
  iv_di_mc_enabled_flag[2] flag
  iv_mv_scal_enabled_flag[2] flag
  log2_ivmc_sub_pb_size_minus3 ue
  iv_res_pred_enabled_flag flag
  depth_ref_enabled_flag flag
  vsp_mc_enabled_flag flag
  dbbp_enabled_flag flag
  tex_mc_enabled_flag flag
  log2_texmc_sub_pb_size_minus3 ue
  intra_contour_enabled_flag flag
  intra_dc_only_wedge_enabled_flag flag
  cqt_cu_part_pred_enabled_flag flag
  inter_dc_only_enabled_flag flag
  skip_intra_enabled_flag flag

table palette_values(count, bits)
  check bits <= 64 : palette initializer bit depth must be at most 64
  values[count] u(bits)

table sps_scc(chroma, luma_minus8, chroma_minus8)
  sps_curr_pic_ref_enabled_flag flag
  palette_mode_enabled_flag flag
  if palette_mode_enabled_flag
    palette_max_size ue
    delta_palette_max_predictor_size ue
    sps_palette_predictor_initializers_present_flag flag
    if sps_palette_predictor_initializers_present_flag
      sps_num_palette_predictor_initializers_minus1 ue
      palette_predictor_initializers[1 if chroma == 0 else 3] = palette_values(sps_num_palette_predictor_initializers_minus1 + 1, 8 + (chroma_minus8 if index else luma_minus8))
  motion_vector_resolution_control_idc u(2)
  intra_boundary_filtering_disabled_flag flag

table pps()
  pps_pic_parameter_set_id ue
  pps_seq_parameter_set_id ue
  dependent_slice_segments_enabled_flag flag
  output_flag_present_flag flag
  num_extra_slice_header_bits u(3)
  sign_data_hiding_enabled_flag flag
  cabac_init_present_flag flag
  num_ref_idx_l0_default_active_minus1 ue
  num_ref_idx_l1_default_active_minus1 ue
  init_qp_minus26 se
  constrained_intra_pred_flag flag
  transform_skip_enabled_flag flag
  cu_qp_delta_enabled_flag flag
  if cu_qp_delta_enabled_flag
    diff_cu_qp_delta_depth ue
  pps_cb_qp_offset se
  pps_cr_qp_offset se
  pps_slice_chroma_qp_offsets_present_flag flag
  weighted_pred_flag flag
  weighted_bipred_flag flag
  transquant_bypass_enabled_flag flag
  tiles_enabled_flag flag
  entropy_coding_sync_enabled_flag flag
  if tiles_enabled_flag
    tiles = pps_tiles()
  pps_loop_filter_across_slices_enabled_flag flag
  deblocking_filter_control_present_flag flag
  if deblocking_filter_control_present_flag
    deblocking_filter_control = pps_deblocking()
  pps_scaling_list_data_present_flag flag
  if pps_scaling_list_data_present_flag
    scaling_list_data = scaling_list_data()
  lists_modification_present_flag flag
  log2_parallel_merge_level_minus2 ue
  slice_segment_header_extension_present_flag flag
  pps_extension_present_flag flag
  if pps_extension_present_flag
    pps_extension = pps_extension(transform_skip_enabled_flag)
  else
    trailing

table pps_tiles()
  num_tile_columns_minus1 ue
  num_tile_rows_minus1 ue
  uniform_spacing_flag flag
  if not uniform_spacing_flag
    column_width_minus1[num_tile_columns_minus1] ue
    row_height_minus1[num_tile_rows_minus1] ue
  loop_filter_across_tiles_enabled_flag flag

table pps_deblocking()
  deblocking_filter_override_enabled_flag flag
  pps_deblocking_filter_disabled_flag flag
  if not pps_deblocking_filter_disabled_flag
    pps_beta_offset_div2 se
    pps_tc_offset_div2 se

table pps_extension(transform_skip)
  pps_range_extension_flag flag
  pps_multilayer_extension_flag flag
  pps_3d_extension_flag flag
  pps_scc_extension_flag flag
  pps_extension_4bits u(4)
  if pps_range_extension_flag
    range_extension = pps_range(transform_skip)
  if pps_multilayer_extension_flag
    multilayer_extension = pps_multilayer()
  if pps_3d_extension_flag
    three_d_extension = pps_3d()
  if pps_scc_extension_flag
    scc_extension = pps_scc()
  if pps_extension_4bits != 0
    extension_data data
  trailing

table qp_pair()
  cb se
  cr se

table pps_range(transform_skip)
  if transform_skip
    log2_max_transform_skip_block_size_minus2 ue
  cross_component_prediction_enabled_flag flag
  chroma_qp_offset_list_enabled_flag flag
  if chroma_qp_offset_list_enabled_flag
    diff_cu_chroma_qp_offset_depth ue
    chroma_qp_offset_list_len_minus1 ue
    qp_offset_list[chroma_qp_offset_list_len_minus1 + 1] = qp_pair()
  log2_sao_offset_scale_luma ue
  log2_sao_offset_scale_chroma ue

table reference_location()
  layer_id u(6)
  scaled_ref_layer_offset_present flag
  if scaled_ref_layer_offset_present
    scaled_ref_layer_offsets[4] se
  ref_region_offset_present flag
  if ref_region_offset_present
    ref_region_offsets[4] se
  resample_phase_present flag
  if resample_phase_present
    resample_phase[4] ue

table pps_multilayer()
  poc_reset_info_present_flag flag
  pps_infer_scaling_list_flag flag
  if pps_infer_scaling_list_flag
    pps_scaling_list_ref_layer_id u(6)
  num_ref_loc_offsets ue
  reference_location_offsets[num_ref_loc_offsets] = reference_location()
  colour_mapping_enabled_flag flag
  if colour_mapping_enabled_flag
    colour_mapping_table = colour_mapping()

table colour_mapping()
  num_cm_ref_layers_minus1 ue
  cm_ref_layer_id[num_cm_ref_layers_minus1 + 1] u(6)
  cm_octant_depth u(2)
  cm_y_part_num_log2 u(2)
  luma_bit_depth_cm_input_minus8 ue
  chroma_bit_depth_cm_input_minus8 ue
  luma_bit_depth_cm_output_minus8 ue
  chroma_bit_depth_cm_output_minus8 ue
  cm_res_quant_bits u(2)
  cm_delta_flc_bits_minus1 u(2)
  if cm_octant_depth == 1
    cm_adapt_threshold_u_delta se
    cm_adapt_threshold_v_delta se
  let rest = max(0, 10 + luma_bit_depth_cm_input_minus8 - luma_bit_depth_cm_output_minus8 - cm_res_quant_bits - cm_delta_flc_bits_minus1 - 1)
  root = octant(0, 0, 0, 0, 1 << cm_octant_depth, cm_octant_depth, 1 << cm_y_part_num_log2, rest)

table octant(depth, y, cb, cr, length, most, parts, rest)
  set input_depth = depth
  set idx_y = y
  set idx_cb = cb
  set idx_cr = cr
  set split_octant_flag = False
  if depth < most
    split_octant_flag flag
  if split_octant_flag
    let half = length // 2
    children[8] = octant(depth + 1, y + parts * (index // 4) * half, cb + (index // 2 % 2) * half, cr + (index % 2) * half, half, most, parts, rest)
  else
    vertices[4 * parts] = vertex(rest)

table vertex(rest)
  coded_res_flag flag
  if coded_res_flag
    residuals[3] = vertex_residual(rest)

table vertex_residual(rest)
  res_coeff_q ue
  set res_coeff_r = 0
  if rest > 0
    res_coeff_r u(rest)
  set res_coeff_s = False
  if res_coeff_q != 0 or res_coeff_r != 0
    res_coeff_s flag

table pps_3d()
  dlts_present_flag flag
  if dlts_present_flag
    pps_depth_layers_minus1 u(6)
    pps_bit_depth_for_depth_layers_minus8 u(4)
    depth_layers[pps_depth_layers_minus1 + 1] = depth_layer(index, pps_bit_depth_for_depth_layers_minus8 + 8)

table depth_layer(layer, bits)
  dlt_flag flag
  if dlt_flag
    dlt_pred_flag flag
    set listed = False
    if layer == 0 or not dlt_pred_flag
      dlt_val_flags_present_flag flag
      set listed = dlt_val_flags_present_flag
    if listed
      dlt_value_flags[1 << bits] flag
    else
      delta_dlt = delta_dlt(bits)

table delta_dlt(bits)
  num_val_delta_dlt u(bits)
  let most = 0
  if num_val_delta_dlt > 1
    max_diff u(bits)
    let most = max_diff
  let least = max(most - 1, 0) + 1
  if num_val_delta_dlt > 2 and most > 0
    min_diff_minus1 u(width(most + 1))
    let least = min_diff_minus1 + 1
  if num_val_delta_dlt > 0
    delta_dlt_val0 u(bits)
  if most > least
    delta_val_diff_minus_min[max(num_val_delta_dlt - 1, 0)] u(width(most - least + 1))

table pps_scc()
  pps_curr_pic_ref_enabled_flag flag
  residual_adaptive_colour_transform_enabled_flag flag
  if residual_adaptive_colour_transform_enabled_flag
    pps_slice_act_qp_offsets_present_flag flag
    pps_act_y_qp_offset_plus5 se
    pps_act_cb_qp_offset_plus5 se
    pps_act_cr_qp_offset_plus3 se
  pps_palette_predictor_initializers_present_flag flag
  if pps_palette_predictor_initializers_present_flag
    pps_num_palette_predictor_initializers ue
    if pps_num_palette_predictor_initializers > 0
      monochrome_palette_flag flag
      luma_bit_depth_entry_minus8 ue
      let second = 0
      if not monochrome_palette_flag
        chroma_bit_depth_entry_minus8 ue
        let second = chroma_bit_depth_entry_minus8
      palette_predictor_initializers[1 if monochrome_palette_flag else 3] = palette_values(pps_num_palette_predictor_initializers, 8 + (second if index else luma_bit_depth_entry_minus8))

table sei_message()
  set payload_type = chained()
  set payload_size = chained()
  payload[payload_size] u(8)

table sei()
  messages[until] = sei_message()
  trailing

table aud()
  pic_type u(3)
  trailing

table filler()
  set filler_byte_count = run_of(255)
  trailing

table empty()
  check left() == 0 : the payload must be empty

table long_term(sps_entry, idx_bits, poc_bits)
  if sps_entry
    lt_idx_sps u(idx_bits)
  else
    poc_lsb_lt u(poc_bits)
    used_by_curr_pic_lt_flag flag
  delta_poc_msb_present_flag flag
  if delta_poc_msb_present_flag
    delta_poc_msb_cycle_lt ue

table slice_rps(c, poc_bits)
  let sets = c['short_term_ref_pic_sets']
  set short_term_ref_pic_set_sps_flag = False
  if sets
    short_term_ref_pic_set_sps_flag flag
  if short_term_ref_pic_set_sps_flag
    if len(sets) > 1
      short_term_ref_pic_set_idx u(width(len(sets)))
  else
    short_term_ref_pic_set = st_ref_pic_set(len(sets), sets, len(sets))
  set num_long_term_pics = 0
  if c['long_term_ref_pics_present_flag']
    let known = c['num_long_term_ref_pics_sps']
    let own = 0
    if known > 0
      num_long_term_sps ue
      let own = num_long_term_sps
    num_long_term_pics ue
    check own <= known : slice long-term SPS reference count exceeds SPS count
    long_term_pictures[own + num_long_term_pics] = long_term(index < own, width(known), poc_bits)

table weights(count, chroma, current)
  flags[count] = weight_flag(index < len(current) and current[index])
  set luma_weight_flags = [f.get('weight', False) for f in flags]
  set chroma_weight_flags = [False] * count
  if chroma
    second[count] = weight_flag(index < len(current) and current[index])
    set chroma_weight_flags = [f.get('weight', False) for f in second]
  entries[count] = weight_entry(luma_weight_flags[index], chroma_weight_flags[index])

table weight_flag(none)
  if not none
    weight flag

table weight_entry(luma, chroma)
  if luma
    delta_luma_weight se
    luma_offset se
  if chroma
    chroma_weight_offset[4] se

table slice_tail(c)
  if c['tiles_enabled_flag'] or c['entropy_coding_sync_enabled_flag']
    num_entry_point_offsets ue
    if num_entry_point_offsets > 0
      offset_len_minus1 ue
      check offset_len_minus1 < 64 : entry-point offset width must be at most 64
      entry_point_offset_minus1[num_entry_point_offsets] u(offset_len_minus1 + 1)
  if c['slice_segment_header_extension_present_flag']
    slice_segment_header_extension_length ue
    slice_segment_header_extension_data[slice_segment_header_extension_length] u(8)
  align

table slice_header(c)
  first_slice_segment_in_pic_flag flag
  if 16 <= c['nal_unit_type'] <= 23
    no_output_of_prior_pics_flag flag
  slice_pic_parameter_set_id ue
  set dependent_slice_segment_flag = False
  if not first_slice_segment_in_pic_flag
    if c['dependent_slice_segments_enabled_flag']
      dependent_slice_segment_flag flag
    slice_segment_address u(c['slice_segment_address_bits'])
  if not dependent_slice_segment_flag
    independent = slice_body(c)
  tail = slice_tail(c)

table slice_body(c)
  slice_reserved_flags[c['num_extra_slice_header_bits']] flag
  slice_type ue
  if c['output_flag_present_flag']
    pic_output_flag flag
  if c['separate_colour_plane_flag']
    colour_plane_id u(2)
  let temporal = False
  if c['nal_unit_type'] not in (19, 20)
    let poc_bits = c['log2_max_pic_order_cnt_lsb_minus4'] + 4
    check poc_bits <= 64 : POC LSB bit width must be at most 64
    slice_pic_order_cnt_lsb u(poc_bits)
    reference_picture_set = slice_rps(c, poc_bits)
    if c['sps_temporal_mvp_enabled_flag']
      slice_temporal_mvp_enabled_flag flag
      let temporal = slice_temporal_mvp_enabled_flag
  let offsets = False
  if c['sample_adaptive_offset_enabled_flag']
    slice_sao_luma_flag flag
    let offsets = slice_sao_luma_flag
    if c['chroma_array_type_nonzero']
      slice_sao_chroma_flag flag
      let offsets = offsets or slice_sao_chroma_flag
  check slice_type <= 2 : slice_type must be B, P, or I
  if slice_type < 2
    num_ref_idx_active_override_flag flag
    set num_ref_idx_l0_active_minus1 = c['num_ref_idx_l0_default_active_minus1']
    let second = 0
    if num_ref_idx_active_override_flag
      num_ref_idx_l0_active_minus1 ue
    if slice_type == 0
      set num_ref_idx_l1_active_minus1 = c['num_ref_idx_l1_default_active_minus1']
      if num_ref_idx_active_override_flag
        num_ref_idx_l1_active_minus1 ue
      let second = num_ref_idx_l1_active_minus1
    if c['lists_modification_present_flag'] and c['num_pic_total_curr'] > 1
      modification_flag_l0 flag
      if modification_flag_l0
        list_entry_l0[num_ref_idx_l0_active_minus1 + 1] u(width(c['num_pic_total_curr']))
      if slice_type == 0
        modification_flag_l1 flag
        if modification_flag_l1
          list_entry_l1[num_ref_idx_l1_active_minus1 + 1] u(width(c['num_pic_total_curr']))
    if slice_type == 0
      mvd_l1_zero_flag flag
    if c['cabac_init_present_flag']
      cabac_init_flag flag
    if temporal
      set collocated_from_l0_flag = True
      if slice_type == 0
        collocated_from_l0_flag flag
      if (num_ref_idx_l0_active_minus1 if collocated_from_l0_flag else second) > 0
        collocated_ref_idx ue
    if (c['weighted_pred_flag'] and slice_type == 1) or (c['weighted_bipred_flag'] and slice_type == 0)
      luma_log2_weight_denom ue
      if c['chroma_array_type_nonzero']
        delta_chroma_log2_weight_denom se
      weights_l0 = weights(num_ref_idx_l0_active_minus1 + 1, c['chroma_array_type_nonzero'], c['l0_reference_is_current'])
      if slice_type == 0
        weights_l1 = weights(second + 1, c['chroma_array_type_nonzero'], c['l1_reference_is_current'])
    five_minus_max_num_merge_cand ue
    if c['motion_vector_resolution_control_idc'] == 2
      use_integer_mv_flag flag
  slice_qp_delta se
  if c['pps_slice_chroma_qp_offsets_present_flag']
    slice_cb_qp_offset se
    slice_cr_qp_offset se
  if c['pps_slice_act_qp_offsets_present_flag']
    slice_act_qp_offsets[3] se
  if c['chroma_qp_offset_list_enabled_flag']
    cu_chroma_qp_offset_enabled_flag flag
  let override = False
  if c['deblocking_filter_override_enabled_flag']
    deblocking_filter_override_flag flag
    let override = deblocking_filter_override_flag
  set slice_deblocking_filter_disabled_flag = c['pps_deblocking_filter_disabled_flag']
  if override
    slice_deblocking_filter_disabled_flag flag
    if not slice_deblocking_filter_disabled_flag
      slice_deblocking_offsets[2] se
  if c['pps_loop_filter_across_slices_enabled_flag'] and (offsets or not slice_deblocking_filter_disabled_flag)
    slice_loop_filter_across_slices_enabled_flag flag
"""

#: What a slice header is read with where nothing else is known.
CONTEXT: dict[str, Any] = dict.fromkeys(
    """dependent_slice_segments_enabled_flag output_flag_present_flag separate_colour_plane_flag long_term_ref_pics_present_flag sps_temporal_mvp_enabled_flag
    sample_adaptive_offset_enabled_flag lists_modification_present_flag weighted_pred_flag weighted_bipred_flag cabac_init_present_flag pps_slice_chroma_qp_offsets_present_flag
    pps_slice_act_qp_offsets_present_flag chroma_qp_offset_list_enabled_flag deblocking_filter_override_enabled_flag pps_deblocking_filter_disabled_flag
    pps_loop_filter_across_slices_enabled_flag tiles_enabled_flag entropy_coding_sync_enabled_flag slice_segment_header_extension_present_flag""".split(),
    False,
) | dict.fromkeys(
    """nal_unit_type slice_segment_address_bits num_extra_slice_header_bits log2_max_pic_order_cnt_lsb_minus4 num_long_term_ref_pics_sps num_ref_idx_l0_default_active_minus1
    num_ref_idx_l1_default_active_minus1 num_pic_total_curr motion_vector_resolution_control_idc""".split(),
    0,
)
CONTEXT |= {"chroma_array_type_nonzero": True, "short_term_ref_pic_sets": [], "l0_reference_is_current": [], "l1_reference_is_current": []}

_FIELD = re.compile(r"(\w+)(?:\[(.+)\])? (flag|ue|se|data|u\((.+)\))$")
_TABLE = re.compile(r"(\w+)(?:\[(.+)\])? = (\w+)\((.*)\)$")


def width(n: int) -> int:
    """Bits that tell n values apart."""
    return max(n - 1, 0).bit_length()


def _code(text: str):
    return int(text) if text.isdigit() else compile(text, f"<{text}>", "eval")


@lru_cache(maxsize=1)
def _tables() -> dict[str, tuple[list[str], list]]:
    """Tables by name: their parameters and their steps, nested by indentation."""
    out = {}
    for block in TABLES.strip().split("\ntable "):
        head, *lines = block.removeprefix("table ").strip("\n").split("\n")
        name, _, rest = head.partition("(")
        params = [p.strip() for p in rest.rstrip(")").split(",") if p.strip()]
        steps, at = _steps(lines, 0, 2)
        if at != len(lines):
            raise ValueError(f"table {name}: line {at}")
        out[name] = params, steps
    return out


def _steps(lines: list[str], at: int, indent: int) -> tuple[list, int]:
    steps: list = []
    while at < len(lines):
        text = lines[at]
        depth = len(text) - len(text.lstrip())
        if depth < indent:
            break
        text = text.strip()
        word, _, rest = text.partition(" ")
        if word in ("if", "elif", "else"):
            inner, after = _steps(lines, at + 1, indent + 2)
            branch = (_code(rest) if rest else None, inner)
            if word == "if":
                steps.append(("if", [branch]))
            else:
                steps[-1][1].append(branch)
            at = after
            continue
        if word in ("let", "set"):
            name, _, expression = rest.partition(" = ")
            steps.append((word, name, _code(expression)))
        elif word == "check":
            condition, _, message = rest.partition(" : ")
            steps.append(("check", _code(condition), message))
        elif text in ("trailing", "align"):
            steps.append((text,))
        elif m := _TABLE.match(text):
            count = "until" if m[2] == "until" else _code(m[2]) if m[2] else None
            steps.append(("table", m[1], count, m[3], _code(f"({m[4]},)" if m[4] else "()")))
        elif m := _FIELD.match(text):
            steps.append(("field", m[1], _code(m[2]) if m[2] else None, m[3].split("(")[0], _code(m[4]) if m[4] else None))
        else:
            raise ValueError(f"not understood: {text}")
        at += 1
    return steps, at


class _Run:
    """Reads one table after the other from a reader."""

    def __init__(self, reader: BitReader) -> None:
        self.reader = reader
        self.tools = {
            "position": lambda: reader.at, "since": self.since, "ahead": reader.peek, "skip": reader.u, "width": width, "running": _running, "left": lambda: reader.left,
            "chained": self.chained, "run_of": self.run_of, "raised": lambda flags: {k for k, f in enumerate(flags) if f},
        }

    def since(self, begin: int) -> int:
        return BitReader(self.reader.data, begin, self.reader.at).peek(self.reader.at - begin)

    def chained(self) -> int:
        """Bytes added up to the first that isn't 255."""
        total = 0
        while (byte := self.reader.u(8)) == 255:
            total += byte
        return total + byte

    def run_of(self, byte: int) -> int:
        n = 0
        while self.reader.left >= 8 and self.reader.peek(8) == byte:
            self.reader.u(8)
            n += 1
        return n

    def table(self, name: str, args: tuple) -> dict[str, Any]:
        params, steps = _tables()[name]
        if len(args) != len(params):
            raise TypeError(f"{name} takes {params}")
        fields: dict[str, Any] = {}
        self.steps(steps, fields, dict(zip(params, args, strict=True)) | self.tools)
        fields.pop("hidden", None)
        return fields

    def steps(self, steps: list, fields: dict[str, Any], local: dict[str, Any]) -> None:
        reader, scope = self.reader, ChainMap(fields, local)

        def value(code) -> Any:
            # the expressions are the constants above
            return code if code.__class__ is int else eval(code, _KNOWN, scope)

        for step in steps:
            kind = step[0]
            if kind == "field":
                _, name, count, descriptor, bits = step
                if descriptor == "data":
                    got: Any = []
                    while reader.more_data():
                        got.append(bool(reader.u(1)))
                else:
                    n = value(bits) if bits is not None else 1
                    one = {"flag": lambda: bool(reader.u(1)), "ue": reader.ue, "se": reader.se, "u": lambda n=n: reader.u(n)}[descriptor]
                    got = [one() for _ in range(_bounded(value(count)))] if count is not None else one()
                fields[name] = got
            elif kind == "table":
                _, name, count, table, args = step
                if count is None:
                    fields[name] = self.table(table, value(args))
                elif count == "until":
                    fields[name] = [self.table(table, value(args))]
                    while reader.more_data():
                        fields[name].append(self.table(table, value(args)))
                else:
                    n = _bounded(value(count))
                    fields[name] = []
                    for local["index"] in range(n):
                        fields[name].append(self.table(table, value(args)))
            elif kind == "let":
                local[step[1]] = value(step[2])
            elif kind == "set":
                fields[step[1]] = value(step[2])
            elif kind == "if":
                for condition, inner in step[1]:
                    if condition is None or value(condition):
                        self.steps(inner, fields, local)
                        break
            elif kind == "check":
                if not value(step[1]):
                    raise BitstreamError("invalid syntax value", step[2])
            else:
                getattr(reader, step[0])()


#: The few functions that tables use.
_KNOWN = {"__builtins__": {f.__name__: f for f in (any, len, max, min, range, set, sum, zip)}}


def _running(first: int, deltas: list[int]) -> list[int]:
    out = []
    for d in deltas:
        first = (first + d) % 256
        out.append(first)
    return out


def _bounded(n: int) -> int:
    if n > MOST:
        raise BitstreamError("invalid syntax value", "too many entries")
    return n


def read_table(name: str, reader: BitReader, *args: Any) -> dict[str, Any]:
    return _Run(reader).table(name, args)


#: Tables by unit type.
KINDS = {32: "vps", 33: "sps", 34: "pps", 35: "aud", 36: "empty", 37: "empty", 38: "filler", 39: "sei", 40: "sei"}


def unit_header(unit: bytes) -> tuple[int, int, int]:
    """(type, layer, temporal id + 1) of a unit."""
    if len(unit) < 2:
        raise BitstreamError("invalid unit header", "a unit has two bytes at least")
    word = int.from_bytes(unit[:2], "big")
    if word >> 15:
        raise BitstreamError("invalid unit header", "forbidden_zero_bit is not zero")
    if not word & 7:
        raise BitstreamError("invalid unit header", "nuh_temporal_id_plus1 is not greater than zero")
    return word >> 9 & 63, word >> 3 & 63, word & 7


def parse_payload(unit_type: int, payload: bytes) -> dict[str, Any] | None:
    """The fields of a payload; None for types that have no table. All bits must be used."""
    if unit_type not in KINDS:
        return None
    reader = BitReader(payload)
    fields = read_table(KINDS[unit_type], reader)
    if reader.left:
        raise BitstreamError("invalid syntax value", "the payload isn't used up")
    return fields


def slice_context(unit_type: int, sps: dict[str, Any], pps: dict[str, Any], address_bits: int) -> dict[str, Any]:
    """What a slice header is read with, from its parameter sets."""
    deblocking, extension = pps.get("deblocking_filter_control", {}), pps.get("pps_extension", {})
    out = CONTEXT | {k: v for source in (sps, pps) for k, v in source.items() if k in CONTEXT}
    return out | {
        "nal_unit_type": unit_type,
        "slice_segment_address_bits": address_bits,
        "chroma_array_type_nonzero": sps["chroma_format_idc"] != 0 and not sps["separate_colour_plane_flag"],
        "deblocking_filter_override_enabled_flag": deblocking.get("deblocking_filter_override_enabled_flag", False),
        "pps_deblocking_filter_disabled_flag": deblocking.get("pps_deblocking_filter_disabled_flag", False),
        "pps_slice_act_qp_offsets_present_flag": extension.get("scc_extension", {}).get("pps_slice_act_qp_offsets_present_flag", False),
        "chroma_qp_offset_list_enabled_flag": extension.get("range_extension", {}).get("chroma_qp_offset_list_enabled_flag", False),
        "motion_vector_resolution_control_idc": sps.get("sps_extension", {}).get("scc_extension", {}).get("motion_vector_resolution_control_idc", 0),
    }


def slice_pps_id(unit_type: int, payload: bytes) -> int:
    """The parameter set that a slice names, without reading on."""
    reader = BitReader(payload)
    reader.u(2 if 16 <= unit_type <= 23 else 1)
    return reader.ue()


def trailing_words(reader: BitReader) -> int:
    """The zero words behind the closing bits of a slice."""
    reader.trailing()
    n = 0
    while reader.left >= 16:
        if reader.u(16):
            raise BitstreamError("invalid syntax value", "cabac_zero_word must equal 0x0000")
        n += 1
    if reader.left:
        raise BitstreamError("invalid syntax value", "trailing CABAC data must be a whole number of words")
    return n
