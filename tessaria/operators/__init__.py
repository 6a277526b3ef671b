"""tessaria.operators"""
