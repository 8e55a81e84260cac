"""Process names and the functions that carry them out."""

from __future__ import annotations

from importlib import import_module

# Process names by module, as "Name:function".
_TABLE = {
    "vector": "CountFeatures:count_features SumAreas:sum_areas SelectFeatures:select_features CalculateField:calculate_field CalculateArea:calculate_area CalculateLength:calculate_length CalculateXYCoordinate:calculate_xy MergeFeatures:merge_features Reproject:reproject GeometryToFeatures:geometry_to_features ForceDimension:force_dimension",
    "joins": "AttributeJoin:attribute_join SpatialJoin:spatial_join Near:near NearestNeighborCount:nearest_neighbor_count KNearestNeighborMap:knn_map KNearestNeighborCircle:knn_circle HubLinesByDistance:hub_lines_by_distance HubLinesByID:hub_lines_by_id SnapPointsToLines:snap_points_to_lines PointStatistics:point_statistics BufferPointStatistics:buffer_point_statistics SumLineLength:sum_line_length",
    "aggregate": "Dissolve:dissolve UnionPolygon:union_polygon SinglepartToMultipart:singlepart_to_multipart CollectEvents:collect_events CollectFeatures:collect_features DeleteDuplicates:delete_duplicates SpatialClumpMap:spatial_clumps",
    "distribution": "MeanCenter:mean_center MedianCenter:median_center CentralFeature:central_feature StandardDistance:standard_distance StandardDeviationalEllipse:std_dev_ellipse LinearDirectionalMean:linear_directional_mean",
    "autocorr": "GlobalMoransI:global_morans_i GlobalGStatistics:global_g GlobalGearysC:global_gearys_c GlobalLeesS:global_lees_s GlobalLeesL:global_lees_l GlobalRogersonR:global_rogersons_r JoinCount:join_count LocalMoransI:local_morans_i LocalGStatistics:local_g LocalGearysC:local_gearys_c LocalLeesS:local_lees_s LocalLeesL:local_lees_l LocalRogersonR:local_rogersons_r FocalLQ:focal_lq StandardizedScores:standardized_scores",
    "composed": "LocalSABinning:local_sa_binning LocalSAOverlay:local_sa_overlay",
    "stats": "StatisticsFeatures:statistics NearestNeighborIndex:nearest_neighbor_index QuadratAnalysis:quadrat KMeansClustering:k_means ClusterGAM:cluster_gam ClusterBesagNewell:besag_newell Pearson:pearson OrdinaryLeastSquares:ols",
    "grids": "RectangularBinning:rectangular_binning HexagonalBinning:hexagonal_binning CircularBinning:circular_binning FishnetCount:fishnet FishnetSize:fishnet_by_size Hexagon:hexagon_grid TriangularGrid:triangular_grid CircularGrid:circular_grid PolarGridsFromFeatures:polar_grids PolarGridsFromGeometry:polar_grids_from_point RandomPoints:random_points RandomPointsPerFeatures:random_points_per_feature RegularPoints:regular_points WindRoseMap:wind_rose MultiWindRoseMap:multi_wind_rose RingMap:ring_map",
    "buffers": "BufferFeatures:buffer_features MultipleRingBuffer:multiple_ring_buffer SingleSidedBuffer:single_sided_buffer WedgeBuffer:wedge_buffer VariableBuffer:variable_buffer",
    "construct": "FeatureToPoint:feature_to_point FeatureToLine:feature_to_line FeatureToPolygon:feature_to_polygon FeatureEnvelopeToPolygon:envelope_to_polygon FeatureToConvexHull:convex_hull FeatureToMinimumBoundingCircle:bounding_circle FeatureToMinimumRectangle:minimum_rectangle FeatureToOctagonalEnvelope:octagonal_envelope FeatureToMaximumInscribedCircle:inscribed_circle FeatureToMaximumInscribedRectangle:inscribed_rectangle MultipartToSinglepart:multipart_to_singlepart PointsToLine:points_to_line VerticesToPoints:vertices_to_points PointsAlongLines:points_along_lines PolygonsAlongLines:polygons_along_lines FlowMap:flow_map ConcaveHull:concave_hull ThiessenPolygon:thiessen DelaunayTriangulation:delaunay",
    "edit": "SplitPolygonByCount:split_polygon_by_count SplitLineByDistance:split_line_by_distance SplitLineAtVertices:split_line_at_vertices SplitLineAtPoint:split_line_at_point OffsetFeatures:offset RotateFeatures:rotate ScaleFeatures:scale TrimLine:trim_line ExtendLine:extend_line IntersectionPoints:intersection_points Simplify:simplify SimplifyPolygon:simplify_polygon Densify:densify Smooth:smooth RemoveHoles:remove_holes RemoveParts:remove_parts FlipLine:flip_line Eliminate:eliminate RepairGeometry:repair",
    "overlay": "ClipWithGeometry:clip_with_geometry ClipWithFeatures:clip_with_features Difference:difference SymDifference:sym_difference Update:update Intersect:intersect Union:union Identity:identity",
    "rastervec": "RasterToPoint:to_points RasterToGridPolygon:to_grid_polygons RasterToPolygon:to_polygons ExtractValuesToPoints:extract_values FeaturesToRaster:features_to_raster PointsToRaster:points_to_raster GeometryToRaster:geometry_to_raster ZonalStatistics:zonal_statistics RasterToImage:to_image",
    "surface": "KernelDensity:kernel_density PointDensity:point_density LineDensity:line_density EuclideanDistance:euclidean_distance IDW:idw TPS:thin_plate_spline TINInterpolation:tin",
    "raster": "RasterHighLowPoints:high_low_points RasterSlope:slope RasterAspect:aspect RasterHillshade:hillshade RasterTPI:tpi RasterTRI:tri RasterRoughness:roughness RasterCurvature:curvature RasterFlowDirection:flow_direction RasterCon:con RasterSetNull:set_null RasterReclass:reclass RasterMath:calculate RasterExtraction:extract RasterReplaceValues:replace_values RasterNDVI:ndvi HistogramGridCoverage:histogram StatisticsGridCoverage:statistics RasterDescribe:describe RasterClipByGeometry:clip RasterClipByExtent:clip RasterClipByCircle:clip_circle RasterClipByFeatures:clip_features RasterCutFill:cut_fill RasterCutFill2:cut_fill_between RasterCutFill3:cut_fill_between RasterSurfaceArea:surface_area RasterProfile:profile RadialLineOfSight:radial_line_of_sight LinearLineOfSight:linear_line_of_sight RasterResample:resample RasterReproject:reproject RasterForceCRS:force_crs RasterFlip:flip RasterMirror:mirror RasterRescale:rescale RasterRotate:rotate RasterShift:shift",
}

PROCESSES: dict[str, str] = {name: f"{module}.{function}" for module, entries in _TABLE.items() for name, function in (e.split(":") for e in entries.split())}


def names() -> list[str]:
    return sorted(PROCESSES)


def process(name: str):
    """The function of a process, by its case-insensitive name."""
    by_lower = {n.lower(): n for n in PROCESSES}
    if name.lower() not in by_lower:
        raise KeyError(f"no process {name}")
    module, function = PROCESSES[by_lower[name.lower()]].split(".")
    return getattr(import_module(f"geoweft.operators.{module}"), function)


def run(name: str, *args, **params):
    return process(name)(*args, **params)
