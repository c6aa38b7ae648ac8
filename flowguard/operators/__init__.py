"""DataFrame-in, DataFrame-out operators: fit returns parameters, apply returns columns."""
