"""DataFrame -> DataFrame operators on grids, gauges, forcings and drainage graphs."""
